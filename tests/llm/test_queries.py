"""The registered queries on small tables of their own."""

from qissaflow.llm import queries as e


def save(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def found(spark, name, folder):
    return sorted(map(tuple, e.queries()[name](spark, folder).collect()), key=str)


def narratives(spark, folder, quick, strict=()):
    return save(spark, folder, all_predictions=(quick, "pred_id bigint, text string"), strict_analysis_300=(list(strict), "ex_id bigint, text string"))


def test_p4_within_and_across_the_tables(spark, tmp_path):
    quick = [(1, "قال المجنون"), (2, "قال  المجنون\n"), (3, "قال المجنون"), (4, "قالَ المجنون"), (5, None), (6, "")]
    folder = narratives(spark, tmp_path, quick, [(7, "قال المجنون"), (8, "شيء آخر")])
    assert found(spark, "p4_found", folder) == [(1, 2), (1, 7), (2, 3), (2, 7), (3, 7)]


def test_p4_pairs_texts_of_blanks_only(spark, tmp_path):
    folder = narratives(spark, tmp_path, [(1, " "), (2, "\u00a0"), (3, ""), (4, None), (5, " ")], [(6, "\u200b")])
    assert found(spark, "p4_found", folder) == [(1, 2), (1, 6), (2, 5), (2, 6), (5, 6)]


def test_p4_of_empty_tables(spark, tmp_path):
    assert found(spark, "p4_found", narratives(spark, tmp_path, [])) == []


def test_p2_counts_characters_and_unbroken_stretches(spark, tmp_path):
    texts = [None, "", "ا" * 2000, "ا" * 2001, "ا" * 1000 + " " + "ا" * 1500, "ا" * 1000 + "\n" + "ا" * 2001, "ا" * 2000 + "، "]
    folder = narratives(spark, tmp_path, list(enumerate(texts)))
    assert found(spark, "p2_found", folder) == [(3, 1), (4, 0), (5, 1), (6, 0)]
    rows = e.queries()["p2_pieces"](spark, folder).orderBy("pred_id", "piece").collect()
    for i in (3, 4, 5, 6):
        own = [r for r in rows if r.pred_id == i]
        assert own[0].piece_start == 0 and own[-1].piece_end == len(texts[i]) and all(len(r.piece_text) <= 2000 for r in own)
        assert all(a.piece_start < b.piece_start <= a.piece_end < b.piece_end for a, b in zip(own, own[1:]))
        assert all(r.piece_text == texts[i][r.piece_start : r.piece_end] for r in own)


def test_p5_spellings_namesakes_and_several_authors(spark, tmp_path):
    plain, odd = "0391IbnTarnuq.Kanz.TXR0007712-ara1", "C:\\openiti\\391_Ibn-Tarnuq\\391_Ibn-Tarnuq.Other.TXR1-ara1"
    upper, url = " 0391IBNTARNUQ.KANZ.TXR0007712-ARA1 ", "0391IbnTarnuq%2EKanz%2ETXR1-ara1"
    tie, far, other = "0391IbnTarnuq+0500AbuB.X.Y-ara1", "0500abub_wa_0600Cim.X.Y-ara1", "0600Cim.Z.Y-ara1"
    files = [plain, odd, upper, url, tie, far, other, "0392IbnTarnuq.Kanz.TXR1-ara1", "anon.X", "anon.Y", None, plain]
    rows = [(k, f) for k, f in enumerate(files)]
    folder = save(spark, tmp_path, all_predictions=(rows, "pred_id bigint, file string"))
    tied = sorted({plain, odd, upper, url, tie, far, other})
    assert found(spark, "p5_found", folder) == sorted((tied[0], x) for x in tied[1:])
    split = dict(found(spark, "p5_splits", folder))
    assert len(split) == len(files) and len({split[k] for k, f in rows if f in tied}) == 1


def test_p6_containers_hold_every_byte_once(spark, tmp_path):
    sizes = [0, 1, 4095, 4096, 4097, 9000, 2047, 2047, 2048, 10]
    rows = [(k, "a" * n) for k, n in enumerate(sizes)] + [(90, None), (91, "م" * 2048)]
    folder = save(spark, tmp_path, documents=(rows, "doc_id bigint, text string"))
    assert found(spark, "p6_found", folder) == [(3,), (4,), (5,), (91,)]
    out = e.queries()["p6_containers"](spark, folder).collect()
    assert sorted((r.doc_id, r.piece) for r in out) == [(1, 0), (2, 0), (3, 0), (3, 1), (4, 0), (4, 1), (5, 0), (5, 1), (5, 2), (6, 0), (7, 0), (8, 0), (9, 0), (91, 0), (91, 1)]
    fills = {r.container: r.fill for r in out}
    assert max(fills.values()) <= 4096 and sum(fills.values()) == sum(n + 1 for n in sizes if n) + 4097
    assert sorted(fills) == list(range(-(-sum(fills.values()) // 4096)))


def test_p7_runs_of_fifteen_words(spark, tmp_path):
    words = "رأيت مجنونا بالبصرة فسألته عن الحكمة فقال العقل في ترك العقل فضحك الخليفة وأعطاه ألف درهم".split()
    run = words[:15]
    texts = [" ".join(run), " ".join(run[:14]), "قبل " + "، ".join(run) + " بعد", " ".join(run[:7]) + "\n~~ PageV01P002 ms12 | " + " ".join(run[7:]), " ".join(run).replace("ا", "اَ").replace("ي", "ی"), " ".join([*run[:7], "غير", *run[7:]]), None, ""]
    docs = [(k, t) for k, t in enumerate(texts)]
    items = [("a", " ".join(words)), ("b", " ".join(words)), ("short", " ".join(run[:14])), ("none", None), ("empty", "")]
    folder = save(spark, tmp_path, documents=(docs, "doc_id bigint, text string"), heldout_items=(items, "id string, text_ar string"))
    assert found(spark, "p7_found", folder) == [(d, i) for d in (0, 2, 3, 4) for i in "ab"]


def test_p1_four_fifths_of_the_longer_text(spark, tmp_path):
    w = [f"كلمة{k}" for k in range(40)]
    quick = [(1, " ".join(w[:20])), (2, "، ".join(w[19::-1])), (3, " ".join(w[:25])), (4, " ".join(w[:26])), (5, " ".join(w[:19])), (6, None), (7, " ".join(w[:16] + w[30:34])), (8, "قال " * 20)]
    folder = narratives(spark, tmp_path, quick, [(9, "قال " * 16 + " ".join(w[:4])), (10, " ".join(w[:20]) + " قالَ")])
    bags = {i: t.replace("،", "").split() for i, t in [*quick, (9, "قال " * 16 + " ".join(w[:4])), (10, " ".join(w[:20]) + " قالَ")] if t}
    want = []
    for a in bags:
        for b in bags:
            n = sum(min(bags[a].count(x), bags[b].count(x)) for x in set(bags[a]))
            if a < b and min(len(bags[a]), len(bags[b])) >= 20 and 5 * n >= 4 * max(len(bags[a]), len(bags[b])):
                want.append((a, b))
    assert (1, 2) in want and (1, 3) in want and (1, 4) not in want and (1, 7) in want and (8, 9) in want
    assert found(spark, "p1_found", folder) == sorted(want, key=str)
    assert dict(found(spark, "p1_groups", folder)) == {1: 1, 2: 1, 3: 1, 4: 1, 7: 1, 10: 1, 8: 8, 9: 8}


def test_groups_count_repeated_rows_and_keep_clashing_columns_apart(spark):
    from qissaflow.llm.charform import consistent_form, look_alike_groups

    rows = [(3, "قال", 1), (1, "قال ", 2), (2, "قال", 3), (4, "غير", 4), (5, None, 5)]
    df = spark.createDataFrame(rows, "k1 bigint, text string, form int")
    got = sorted(map(tuple, look_alike_groups(df, "k1", "text").collect()))
    assert got == [(1, 1, 3, 2), (2, 1, 3, 2), (3, 1, 3, 2), (4, 4, 1, 1)]
    assert sorted(map(tuple, consistent_form(df, "k1", "text").collect())) == [(1, "قال"), (2, "قال"), (3, "قال"), (4, "غير"), (5, None)]
