"""Text primitives for two SQL dialects, word lists, cleaners, normalisers, counts, and the split of chains of transmitters."""
