"""The registered queries of the core and the SQL that checks them."""
