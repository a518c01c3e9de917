"""Registered queries against their SQL, where the driver's tables are there."""

import os

import pytest

from qissaflow.plans import queries

FOLDER = "/root/testdata/sf0.001"
CHECKED = "decisions post_filter_score strict_flags rules_r1_r7 genre_chain structural_flags score_histogram keep_last_join candidates_latest auc_ranks llr_lexicon junun_block cascade_block_a v50scan_features clean_metadata lex_proximity segment_scan segment_v50 segment_cascade_raw morphology_features".split()


def test_every_query_has_a_name_of_its_own_and_sql_names_a_query():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) > 90


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_spark_and_sql_agree(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{FOLDER}/{file}'")
    own, other = queries.queries()[name](spark, FOLDER), con.sql(queries.oracle_sql()[name])
    columns = sorted(own.columns)
    assert columns == sorted(other.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = lambda data, names: sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in data)
    assert rows(map(tuple, own.collect()), own.columns) == rows(other.fetchall(), other.columns)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 20
