"""The pipeline's stages, each on its own input."""

from corpusmill.llm.jaccard import grouped

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = P.table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = P.stored(P.quality(spark, docs, SF), "t1")
    labels = {r["doc_id"]: r["quality"] for r in P.table(spark, SF, "labels").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(i in ids for i in good) >= 0.95 * len(good) and sum(i in ids for i in bad) <= 0.1 * len(bad)
    one = P.stored(P.near_duplicates(spark, kept, SF), "t2")
    groups = {r["doc_id"]: r["component_id"] for r in grouped(kept, 5, 80).collect()}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for c in groups.values()})
    masked = P.stored(P.personal_data(spark, one, SF), "t3")
    assert masked.columns == docs.columns and masked.count() == one.count()
    assert any(rows[r["doc_id"]]["text"] != r["text"] for r in masked.collect()) and all("@mail" not in r["text"] for r in masked.collect())
    mix = P.stored(P.mixing(spark, masked, SF), "t4")
    assert mix.columns == docs.columns
    pieces = P.packing(spark, mix, SF)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(pieces.columns)
    assert P.run(spark, SF).count() > 0 and pieces.count() > 0


def test_null_and_repeated_ids_with_different_texts(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(9)]
    rows = [(None, t) for t in texts[:3]] + [(7, t) for t in texts[3:6]]  # six documents that have nothing in common
    rows += [(7, texts[3]), (None, texts[0])]  # copies of two
    rows += [(5, texts[4] + " end"), (9, texts[5] + " end"), (None, texts[1] + " end"), (2, texts[2] + " end")]  # near copies
    rows += [(11, ""), (12, None), (None, ""), (None, "a b"), (None, "c d")]
    rows = [(i, t, "s") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = P.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in got.collect()]
    pair = [x for x in got if x[1] in (texts[1], texts[1] + " end")]
    assert len(pair) == 1 and pair[0][0] is None
    want = [(None, texts[0]), (2, texts[2] + " end"), (7, texts[3]), (5, texts[4] + " end"), (7, texts[5])]
    want += [(11, ""), (12, None), (None, ""), (None, "a b"), (None, "c d")]
    assert sorted(got, key=str) == sorted(want + pair, key=str)


def odd_documents(spark):
    """Nulls in every column, empty, very long and repeated texts, and columns named like what the stages make."""
    long = " ".join(f"long{i % 997} text, that goes on." for i in range(30_000))
    texts = [None, "", " \n", "one", long, "Write to jane.doe@mail.org or +1 (988) 555-2485, please.", "the same words in a row, " * 30]
    rows = [(i if i % 3 else None, t, "s" if i % 2 else None, None, None if i % 2 else i) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, None, None, None, None)]
    names = "doc_id long, text string, source string, lang string, n_chars long"
    docs = spark.createDataFrame(rows, names).repartition(3)
    return docs.selectExpr("*", "1 AS kept", "'r' AS row", "2 AS node", "3 AS size", "4.0 AS stats", "5 AS _row", "6 AS _part", "7 AS _kept_row", "8 AS shard", "9 AS labelled")


def test_stages_take_nulls_repeats_and_clashing_columns(spark, tmp_path):
    docs = odd_documents(spark)
    spark.createDataFrame([(None, None, None), (1, 1, 0), (2, 0, 0), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    everything = sorted(map(str, docs.select("doc_id", "text").collect()))
    kept = P.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and set(map(str, kept.select("doc_id", "text").collect())) <= set(everything)
    one = P.near_duplicates(spark, docs, str(tmp_path))
    assert one.columns == docs.columns and sorted(map(str, one.select("doc_id", "text").collect())) == sorted(set(everything))
    masked = {(r["doc_id"], r["text"], r["n_chars"]) for r in P.personal_data(spark, docs, str(tmp_path)).collect()}
    assert (5, "Write to [email] or [phone], please.", 36) in masked and (None, None, None) in masked
    mix = P.mixing(spark, docs, str(tmp_path))
    assert mix.columns == docs.columns and mix.filter("trim(text) = ''").count() == 0 and mix.count() > 0
    pieces = P.packing(spark, docs, str(tmp_path))
    assert pieces.agg({"length": "sum"}).first()[0] == sum(r["n"] for r in pieces.filter("start = 0").selectExpr("doc_tokens AS n").collect())
    for name, stage in P.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns), name


def test_stages_without_labels(spark, tmp_path):
    docs = odd_documents(spark)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.quality(spark, docs, str(tmp_path)).count() == docs.count()
