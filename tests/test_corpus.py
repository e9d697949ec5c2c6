"""Deduplication, boilerplate, splits, web payloads, token and score operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.python_udfs import lcs_length
from corpusmill.operators import corpus as C
from corpusmill.operators import reasoning as R
from corpusmill.operators import scores as S
from corpusmill.operators import tokens as K
from corpusmill.plans.text_queries import _cut
from corpusmill.sources import tables as T
from corpusmill.sources import web as W


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_greedy_is_not_components(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert rows(C.greedy_kept(nodes, pairs, _cut)) == [(1,), (3,), (4,)]


def test_minhash_finds_near_copies(spark):
    base = " ".join(f"word{i}" for i in range(300))
    docs = spark.createDataFrame([(1, base), (2, base.replace("word7 ", "other ")), (3, " ".join(f"x{i * i}" for i in range(300))), (4, "")], "doc_id long, text string")
    assert rows(C.candidate_pairs(C.signatures(docs))) == [(1, 2)]


def test_exact_and_boilerplate(spark):
    docs = spark.createDataFrame([(i, "s", f"footer line\nunique {i}") for i in range(20)] + [(99, "t", "footer line\nx")], "doc_id long, source string, text string")
    blocked = C.blocklist(docs)
    assert rows(blocked) == [("s", "footer line", 20)]
    for most in (100, 0):  # broadcast lists and joined lines
        kept = {r["doc_id"]: r["text"] for r in C.without_boilerplate(docs, blocked, most).collect()}
        assert kept[3] == "unique 3" and kept[99] == "footer line\nx"
        twice = C.without_boilerplate(docs.withColumn("doc_id", F.lit(7)), blocked, most)  # rows of one id stay apart
        assert sorted(r["text"] for r in twice.collect()) == sorted([f"unique {i}" for i in range(20)] + ["footer line\nx"])
    assert C.exact_first(docs.withColumn("h", F.lit(1)), "h", ["doc_id"]).count() == 1


def test_first_of_null_keys_and_of_ties(spark):
    docs = spark.createDataFrame([(2, None), (1, None), (4, "a"), (3, "a"), (3, "a"), (None, "b")], "doc_id long, h string")
    assert sorted((tuple(r) for r in C.exact_first(docs, "h", ["doc_id"]).collect()), key=str) == [(1, None), (3, "a"), (None, "b")]


def test_places_in_a_total_order(spark):
    r = random.Random(4)
    values = [(r.randrange(500), i) for i in range(3000)]
    df = spark.createDataFrame(values, "v long, i long").repartition(7)
    got, n, sums = K.numbered(df, [F.desc("v"), "i"], "r", {"total": "v"})
    want, total = [], 0
    for k, (v, i) in enumerate(sorted(values, key=lambda x: (-x[0], x[1])), 1):
        total += v
        want.append((v, i, k, total))
    assert rows(got) == sorted(want) and n == 3000 and sums == {"total": total}
    assert K.numbered(df.limit(0), ["v"], "r")[1] == 0


def test_white_space_of_unicode(spark):
    text = "a\u00a0b\u3000c\u2028 d \n\x1c\n e\u0085\n\nf."
    got = spark.createDataFrame([(text,)], "t string").select(X.words(F.col("t")), X.lines(F.col("t")), X.terminal_fraction(F.col("t"), X.lines(F.col("t")))).first()
    assert got[0] == text.split() and got[1] == [x.strip() for x in text.split("\n") if x.strip()] and abs(got[2] - 1 / 3) < 1e-9
    assert spark.createDataFrame([([3, 1, 3, 3, 2],), ([],)], "x array<int>").select(X.run_lengths(F.col("x"))).collect()[0][0] == [1, 1, 3]


def test_lcs_by_bits():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert lcs_length(a, b) == best[-1][-1]


def test_real_tokens_by_split(spark):
    import public_tokenizers
    import sentencepiece

    from corpusmill.plans.report_queries import token_accounts
    from corpusmill.plans.text_queries import _assigned

    sf = "/root/testdata/sf0.001"
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want: dict = {}
    for x in _assigned(spark, sf).collect():
        n, b, k = want.get((x["split"], x["source_type"]), (0, 0, 0))
        want[x["split"], x["source_type"]] = (n + 1, b + len(x["text"].encode()), k + len(model.encode(x["text"])) + 1)
    assert {(x["split"], x["source_type"]): (x["docs"], x["bytes"], x["tokens"]) for x in token_accounts(spark, sf).collect()} == want


def test_links_of_pages(spark):
    html = '<a href="b.html">x</a><a href="../c/d">y</a><a href="./e?q=1">z</a><a href="//h/f">w</a><a href="http://o/x">v</a><a href="/g.png">u</a><a href="/tag">t</a>'
    pages = spark.createDataFrame([(1, "http://h/a/x/", html)], "page_id long, url string, html string")
    assert {r["link"] for r in W.page_links(pages).collect()} == {"http://h/a/x/b.html", "http://h/a/c/d", "http://h/a/x/e", "http://h/f"}


def test_splits_keep_groups_whole(spark):
    docs = spark.createDataFrame([(i, f"s{i % 7}", f"text {i}") for i in range(300)], "doc_id long, source string, text string")
    got = C.splits(docs)
    assert got.groupBy("group").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    stats = got.groupBy("split").agg(F.count(F.lit(1)).alias("docs"))
    assert C.assert_no_empty_split(stats).count() == 3
    with pytest.raises(Exception, match="empty split"):
        C.assert_no_empty_split(stats.filter("split <> 'val'")).collect()


def test_cross_corpus(spark):
    a = spark.createDataFrame([(1, "the very same text in both"), (2, "only here, quite different words")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "the very same text in both"), (8, "another thing altogether, no overlap")], "doc_id long, text string")
    assert rows(C.cross_collisions(a, b)) == [(1, 7)]


def test_frontier(spark):
    f = spark.createDataFrame([("u1", "d", "pending", 0), ("u2", "d", "pending", 0), ("u3", "e", "claimed", 1)], "url string, domain string, status string, attempts int")
    assert rows(C.claimed(f, 1).select("url")) == [("u1",)]
    more = spark.createDataFrame([("u1", "d", "pending", 0), ("u9", "d", "pending", 0), ("u9", "d", "pending", 0)], f.schema)
    assert C.upsert_absent(f, more, "url").count() == 4


def test_shards_and_manifests(spark, tmp_path):
    docs = spark.createDataFrame([("t1", "hi", "s", "manual", None, None, "a", {"n": "1"}), ("t2", "hi", "s", "manual", None, None, "b", {"n": "2"})], T.DOCUMENT)
    T.write_shards(docs, f"{tmp_path}/j", 1, parquet=False)
    (tmp_path / "j").rename(tmp_path / "k")
    for i, p in enumerate(sorted((tmp_path / "k").glob("*.json.gz"))):
        p.rename(tmp_path / "k" / f"part-{i}.jsonl.gz")
    assert T.read_shards(spark, f"{tmp_path}/k").count() == 2
    T.write_manifests(docs.select(F.lit("train").alias("split"), "doc_id"), f"{tmp_path}/m")
    assert rows(T.read_manifest(spark, f"{tmp_path}/m/split=train")) == [("a",), ("b",)]
    ids = spark.createDataFrame([(1, [1, 258, 65535])], "doc_id long, ids array<int>")
    T.write_tokens(ids, f"{tmp_path}/t")
    assert bytes(spark.read.parquet(f"{tmp_path}/t").first()["ids"]) == bytes([1, 0, 2, 1, 255, 255])


def test_web(spark):
    p = spark.createDataFrame([("<sitemapindex><sitemap><loc>http://a/s1.xml</loc></sitemap></sitemapindex>",), ("<urlset><url><loc>http://a/x</loc></url><url><loc>http://a/x</loc></url>",)], "body string")
    assert rows(W.sitemap_links(p).select("link", "nested")) == [("http://a/s1.xml", True), ("http://a/x", False)]
    r = spark.createDataFrame([("h", "User-agent: *\nDisallow: /private\nAllow: /private/ok\nSITEMAP: http://h/a.xml\nSitemap: http://h/b.xml")], "host string, body string")
    assert rows(W.robots_sitemaps(r)) == [("http://h/a.xml",), ("http://h/b.xml",)]
    urls = spark.createDataFrame([("http://h/private/x",), ("http://h/private/ok/1",), ("http://h/z",), ("http://other/private",)], "url string")
    assert rows(W.allowed(urls, W.robots_rules(r))) == [("http://h/private/ok/1", True), ("http://h/private/x", False), ("http://h/z", True), ("http://other/private", True)]
    wiki = spark.createDataFrame([('{"query": {"allpages": [{"title": "A b"}]}}',)], "body string")
    assert rows(W.wiki_titles(wiki, "http://w/wiki")) == [("http://w/wiki/A_b",)]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, target string")
    assert rows(W.link_crawl(spark.createDataFrame([("a",)], "url string"), links)) == [("a", 0), ("b", 1), ("c", 2)]


def test_tokens(spark):
    t = spark.createDataFrame([(1, list(range(10)))], "doc_id long, ids array<int>")
    got = [(r["start"], list(r["x"]), list(r["y"])) for r in K.windows(t, 4).collect()]
    assert got == [(0, [0, 1, 2, 3], [1, 2, 3, 4]), (4, [4, 5, 6, 7], [5, 6, 7, 8])]
    m = K.prompt_masked(spark.createDataFrame([([1, 2], [3, 4])], "prompt array<int>, target array<int>"), 6).first()
    assert list(m["input"]) == [1, 2, 3, 0, 0] and list(m["labels"]) == [-100, 3, 4, -100, -100]
    logits = spark.createDataFrame([(0, "a", 2.0, False), (0, "b", 1.0, False), (0, "c", -5.0, False)], "step int, token string, logit double, seen boolean")
    assert [r["token"] for r in K.decoded_transform(logits, top_p=0.9).orderBy("token").collect()] == ["a", "b"]
    s = spark.createDataFrame([(1, 0, "x", -1.0), (1, 1, "y", -1.0)], "item int, place int, candidate string, logprob double")
    assert K.forced_choice(s).first()["chosen"] == "x"
    words = spark.createDataFrame([(list("abab"), 5), (list("abc"), 2)], "symbols array<string>, n int")
    assert K.byte_pairs(words, 2) == [("a", "b"), ("ab", "ab")]
    e = K.encoded(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), __import__("public_tokenizers").path("piece_bpe_32k.model"))
    assert e.first()["ids"][-1] == 2


def test_scores(spark):
    p = spark.createDataFrame([(1, "the cat sat", "the cat sat"), (2, "a b", "")], "id int, hypothesis string, reference string")
    assert S.rouge_l(p).first()[0] == 50.0
    same = p.filter("id = 1")
    assert abs(S.bleu(same).first()[0] - 100) < 1e-9 and abs(S.chrf(same).first()[0] - 100) < 1e-9
    loss = spark.createDataFrame([(2.0, 3), (4.0, 1)], "loss double, tokens int")
    assert S.cross_entropy(loss, 4.0).first()["loss"] == 2.5
    w = spark.createDataFrame([(0, 0, 4, 4, 0.5), (0, 0, 4, 2, 0.5), (0, 1, 4, 4, 1.0)], "layer int, head int, q int, k int, p double")
    heads = S.head_kinds(S.attention_heads(w)).orderBy("head").collect()
    assert heads[0]["entropy"] == 1.0 and heads[0]["distance"] == 1.0


def test_reasoning(spark):
    items = R.generated(spark, 900).cache()
    assert items.filter("answer_position < 0").count() == 0 and items.select("category").distinct().count() == 9
    assert rows(items) == rows(R.generated(spark, 900))
    rates = R.rule_accuracy(items)
    assert rates.count() == 9
    cheat = R.rule_answers(items).withColumn("answer", F.coalesce("first_named", "answer")).select(*items.columns)
    assert S.violations(R.rule_accuracy(cheat), list(R.RULES)).filter("rule = 'first_named'").count() > 0
    back = R.renamed(R.renamed(items, {"Asha": "Zzz"}), {"Zzz": "Asha"})
    assert rows(back.select("item", "text", "answer")) == rows(items.select("item", "text", "answer"))
    one = spark.createDataFrame([("A is x. B is y. Who?",)], "text string")
    assert one.select(R.reversed_facts(F.col("text"))).first()[0] == "B is y. A is x. Who?"
    assert one.select(R.swapped(F.col("text"), F.lit("A"), F.lit("B"))).first()[0] == "B is x. A is y. Who?"


def test_langid(spark):
    from corpusmill.operators import langid as L

    rows = [("de", f"der die das und nicht ein haus nummer {i} ist schön") for i in range(40)] + [("en", f"the house and not a number {i} is nice with that") for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    train, test = L.stratified(docs, 0.3)
    assert train.count() + test.count() == 80
    got = L.fitted(train, features=5000).predict(test)
    assert got.filter("pred <> lang").count() == 0 and got.filter("conf < 0.5").count() == 0
    assert spark.createDataFrame([("ab",)], "text string").select(L.char_ngrams(F.col("text"))).first()[0] == [" ab", "ab ", " ab "]


def test_text_perplexity_counts_words_once_in_arrow_batches(spark):
    texts = ["a b a c", "one", "", None, " \u2003\n", "x\u00a0x x", " ".join(str(i % 7) for i in range(500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = K.text_perplexity(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "lambda" not in plan
    want = {x["doc_id"]: x["ppl"] for x in K.pseudo_perplexity(docs.select("doc_id", X.words(F.col("text")).alias("w")), "w").collect()}
    assert {x["doc_id"]: x["ppl"] for x in got.collect()} == pytest.approx(want) and sorted(want) == [0, 1, 5, 6]


def test_token_files_are_packed_in_arrow_batches(spark, tmp_path):
    made = spark.createDataFrame([(1, [0, 65535, 258]), (2, []), (3, None), (4, [7] * 5000)], "id int, ids array<int>")
    T.write_tokens(made, f"{tmp_path}/t")
    raw = {x["id"]: x["ids"] for x in spark.read.parquet(f"{tmp_path}/t").collect()}
    assert bytes(raw[1]) == b"\x00\x00\xff\xff\x02\x01" and raw[2] == b"" and raw[3] is None
    read = T.read_tokens(spark, f"{tmp_path}/t")
    assert "lambda" not in read._jdf.queryExecution().toString()
    assert rows(read) == rows(made)


def test_langid_weighs_ngrams_in_arrow_batches():
    import math
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from corpusmill.functions import gram_vectors as G

    r = random.Random(4)
    words = ["der", "die", "\u00e9tat", "x" * 70, "\u6f22\u5b57", "a\u0301b", "the", "house"]
    texts = ["\u2003".join(r.choice(words) + str(r.randrange(9)) for _ in range(r.randrange(1, 30))) for _ in range(60)] + [" ", None, "\U0001f600"]
    plain = [Counter(w[i : i + n] for x in (t or "").split() for w in [f" {x} "] for n in (3, 4, 5) for i in range(len(w) - n + 1)) for t in texts]
    tf, df = sum(plain, Counter()), Counter(g for c in plain for g in c)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for most in (1, 10**6):
        got_tf, got_df = Counter(), Counter()
        for b in G.totals(most)(iter([batch.slice(0, 40), batch.slice(40)])):
            for g, n, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got_tf[g] += n
                got_df[g] += d
        assert got_tf == tf and got_df == df
    vocabulary = sorted(g for g, d in df.items() if d > 1)
    idf = np.array([math.log((len(texts) + 1) / (df[g] + 1)) for g in vocabulary])
    row, gram, value = G.Weigher(vocabulary, idf)(texts)
    for k, c in enumerate(plain):
        want = {g: (1 + math.log(c[g])) * i for g, i in zip(vocabulary, idf.tolist(), strict=True) if g in c}
        size = math.sqrt(sum(x * x for x in want.values()))
        got = {vocabulary[g]: v for g, v in zip(gram[row == k].tolist(), value[row == k].tolist(), strict=True)}
        assert got == pytest.approx({g: x / size for g, x in want.items()})


def test_langid_report_has_every_held_out_paragraph(spark, tmp_path):
    from corpusmill.operators import langid as L
    from corpusmill.plans.model_queries import langid_report

    words = {"de": "der die das und nicht ein haus", "en": "the house and not a number is"}
    r = random.Random(3)
    rows = [(lang, "\n\n".join(" ".join(r.choice(w.split()) for _ in range(60)) for _ in range(4))) for lang, w in words.items() for _ in range(1200)]
    spark.createDataFrame([*rows, ("en", None), ("de", "short")], "lang string, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    every = L.paragraphs(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    train, test = L.stratified(every)
    want = {x["lang"]: x["count"] for x in test.groupBy("lang").count().collect()}
    assert every.count() > 9000 and min(want.values()) > 300
    assert {x["class"]: x["support"] for x in langid_report(spark, str(tmp_path)).collect()} == want
    twice = train.unionByName(train)
    for k, n in ((50, 50), (10**6, None)):
        got = {x["lang"]: (x["n"], x["m"]) for x in L.sampled(twice, k).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("text").alias("m")).collect()}
        assert got == {lang: (n or m,) * 2 for lang, m in ((x["lang"], x["m"]) for x in train.groupBy("lang").agg(F.countDistinct("text").alias("m")).collect())}


def test_fetched_pages(spark, tmp_path):
    from corpusmill.session import ship
    from corpusmill.sources.fetched import Fetched, Pages

    ship(spark)
    for name in ("a", "b"):
        (tmp_path / name).write_text(f"<p>{name}</p>")
    urls = [f"file://{tmp_path}/a", f"file://{tmp_path}/b", f"file://{tmp_path}/missing", f"file://{tmp_path}/a", ""]
    spark.dataSource.register(Fetched)
    read = spark.read.format("fetched").option("urls", "\n".join(urls)).option("rate", 0).option("attempts", 2)
    got = sorted((r["url"].rsplit("/", 1)[1], r["html"], r["status"], r["attempts"]) for r in read.load().collect())
    assert got == [("a", "<p>a</p>", 200, 1), ("b", "<p>b</p>", 200, 1), ("missing", None, None, 2)]
    assert [len(p.urls) for p in Pages({"urls": "http://a/1\nhttp://b/1\nhttp://a/2"}).partitions()] == [2, 1]
    assert read.option("urls", "").load().count() == 0


def test_settings_and_ids(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"min_chars": 10, "ngram": 3}')
    limits = T.thresholds(T.config(f"{tmp_path}/c.json"))
    assert (limits.min_chars, limits.ngram, limits.max_word_len) == (10, 3, 12.0)
    with pytest.raises(TypeError):
        T.thresholds({"min_char": 1})
    docs = spark.createDataFrame([("abc", "manual", None), ("abc", "downloaded", "x")], "text string, source_type string, doc_id string")
    assert [r["doc_id"] for r in T.finalised(docs).collect()] == ["d8bb14d833d59559", "x"]
    with pytest.raises(Exception, match="unknown source type: other"):
        T.finalised(docs.withColumn("source_type", F.lit("other"))).collect()


def test_signatures_by_batches(spark):
    """Minima agree with plain ones for any text, rows of one id count together, and no shingle becomes a row."""
    import hashlib

    texts = ["", "abc", "abcdef", "\0\0\0\0\0\0", "é€😀xyz" * 7, "plain words, plain words", None, "later part"]
    ids = [1, 2, 3, 4, 5, 6, 7, 6]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    want: dict = {}
    for i, x in zip(ids, texts):
        if x is not None:
            parts = {x[k : k + 5] for k in range(0, max(len(x) - 5, 0) + 1, 2)}
            want.setdefault(i, set()).update(int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % C.PRIME for p in parts)
    got = C.signatures(docs)
    assert {r["doc_id"]: r["sig"] for r in got.collect()} == {
        i: [min((h * a + b) % C.PRIME for h in own) for a, b in C.affine(C.PERMUTATIONS)] for i, own in want.items()
    }
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_cross_met_reads_texts_once(spark):
    docs = spark.createDataFrame(
        [(1, "the same words here", 0), (2, "the same words here", 1), (3, "quite another text", 0), (4, "and a fourth one", 1)],
        "doc_id long, text string, side int"
    )
    assert sorted(r["doc_id"] for r in C.cross_met(docs).collect()) == [1, 2]


def test_cross_counts_fold_copies(spark):
    """Copies count in full without being paired: forty of one text on each side are one pair of nodes."""
    rows = [(i, "one text that is copied often", f"s{i % 4}", i % 2) for i in range(80)] + [(100, "nothing like it at all", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, side int")
    got = C.cross_counts(docs)
    assert {(r["source_a"], r["source_b"]): r["n"] for r in got.collect()} == {(a, b): 400 for a in ("s0", "s2") for b in ("s1", "s3")}


def test_shingle_numbers_make_no_arrays(spark):
    texts = ["", "abc", "ababababababab", "é€😀xyz" * 7, "\0\0\0\0\0\0\0\0"]
    docs = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string")
    want = {i: len({x[k : k + 5] for k in range(0, max(len(x) - 5, 0) + 1, 2)}) for i, x in enumerate(texts)}
    assert {r["doc_id"]: r["n"] for r in C.shingle_numbers(docs).collect()} == want


def test_first_of_a_signature_is_kept(spark, tmp_path):
    """Near copies of one signature and rows without text: kept ids are those of the plain greedy order."""
    from corpusmill.plans.text_queries import lsh_greedy_keep

    rows = [(5, "abcdefghij", "s1"), (3, "abcdefghij", "s2"), (4, None, "s1"), (2, None, "s1"), (8, "", "s1"), (9, "other words", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r["doc_id"] for r in lsh_greedy_keep(spark, str(tmp_path)).collect()) == [2, 3, 8, 9]


def test_tokens_are_counted_in_small_runs(spark, tmp_path):
    """Rows that share an id count once each, and long batches are encoded piece by piece."""
    from corpusmill.plans.report_queries import token_accounts

    assert list(K.batches_of_texts(["aa", "b", "cccc", "d"], 3)) == [(0, 2), (2, 3), (3, 4)]
    spark.createDataFrame([(1, "s1", "a b"), (1, "s1", "a b"), (None, "s1", "a b")], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r["docs"], r["bytes"]) for r in token_accounts(spark, str(tmp_path)).collect()] == [(3, 9)]


def test_measures_and_overlaps_by_rows(spark):
    """Measures and n-gram overlaps are worked out in the row: no lambda over words, no row an n-gram."""
    text = F.col("text")
    docs = spark.createDataFrame([(1, "a b c.\n\n x y?\nx y?"), (2, ""), (3, None), (4, "w " * 9)], "doc_id long, text string")
    got = docs.select("doc_id", X.measured(text).alias("m")).select("doc_id", "m.*")
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {
        1: (7, 10 / 7, 1.0, 0.0, 1 - 2 / 3, 0.0), 2: (0, 0.0, 0.0, 1.0, 0.0, 0.0), 3: (None, 0.0, 0.0, 1.0, None, None),
        4: (9, 1.0, 0.0, 0.0, 0.0, 1 - 1 / 5)
    }
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "lambda" not in plan(docs.select(X.reject_reason(text)))
    pairs = spark.createDataFrame([("a", "a b", "ab c"), ("b", None, "xy"), ("c", "xx", "x")], "id string, hypothesis string, reference string")
    assert "Generate explode(ngrams" not in plan(S.overlaps(pairs, (1, 2)))
    assert sorted(map(tuple, S.overlaps(pairs, (1, 2)).collect())) == [(1, 3, 4, 6), (2, 1, 2, 3)]
    shared = pairs.unionByName(spark.createDataFrame([("a", "c", "")], pairs.schema))  # meets c of the other row
    assert sorted(map(tuple, S.overlaps(shared, (1, 2)).collect())) == [(1, 4, 5, 6), (2, 1, 2, 3)]
