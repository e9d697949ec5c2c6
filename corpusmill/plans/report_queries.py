"""Reports: frontier, web payloads, stages, shares, tokenizers, answers, runs, attention. Most read literal tables."""

from __future__ import annotations

import base64
import gzip

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.python_udfs import payload
from ..operators import corpus as C
from ..operators import langid as L
from ..operators import reasoning as R
from ..operators import reports as P
from ..operators import scores as S
from ..operators import tokens as K
from ..registry import query
from ..functions.python_udfs import word_numbers
from ..sources import tables as T
from ..sources import web as W
from ..sources.tables import table as t
from ..streaming.jobs import folder, requeued
from ..streaming.jobs import stored as _cut
from .fixtures import Fixture
from .text_queries import _ASSIGNED, _GREEDY, _PPL, _TYPE, _WORDS, _assigned, _ppl, lsh_greedy_keep


def on_fixture(name: str, sql: str, *fixtures: Fixture, **named: Fixture):
    """Registers a function of DataFrames made of fixtures; in the SQL, {0}, {1} or {name} stand for the same tables."""

    def add(f):
        @query(name, sql.format(*(x.sql for x in fixtures), **{k: x.sql for k, x in named.items()}))
        def run(spark, d):
            return f(*(x.frame(spark) for x in fixtures), **{k: x.frame(spark) for k, x in named.items()})

        return f

    return add


FRONTIER = Fixture("url string, domain string, status string, attempts int, n_chars long", (
    ("http://a/1", "a", "done", 1, 900), ("http://a/2", "a", "done", 1, 1100), ("http://a/3", "a", "pending", 0, None), ("http://b/1", "b", "pending", 2, None),
    ("http://b/2", "b", "pending", 0, None), ("http://c/1", "c", "failed", 3, None), ("http://c/2", "c", "skipped", 1, None), ("http://c/3", "c", "claimed", 1, None),
))
RESULTS = Fixture(
    "url string, outcome string", (("http://a/3", "ok"), ("http://b/1", "error"), ("http://b/2", "error"), ("http://c/3", "skip"))
)

on_fixture(
    "frontier_stats",
    "SELECT domain, status, count(*) AS urls, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars FROM {0} GROUP BY ALL", FRONTIER
)(P.frontier_stats)
on_fixture("frontier_domains", "SELECT DISTINCT domain FROM {0} WHERE status = 'pending'", FRONTIER)(P.pending_domains)
on_fixture(
    "frontier_marked",
    "SELECT url, domain, CASE outcome WHEN 'ok' THEN 'done' WHEN 'skip' THEN 'skipped' WHEN 'error' THEN CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status, CAST(attempts + CASE WHEN outcome IS NULL THEN 0 ELSE 1 END AS INT) AS attempts FROM {0} LEFT JOIN {1} USING (url)",
    FRONTIER, RESULTS,
)(P.marked)


@on_fixture(
    "frontier_delays",
    "SELECT k, status, CAST(CASE WHEN status = 429 OR status >= 500 THEN 5 * pow(2, k) WHEN status IS NULL THEN pow(2, k) END AS BIGINT) AS delay FROM {0}",
    Fixture("k int, status int", ((0, 429), (1, 503), (2, None), (3, None), (0, 404)))
)
def frontier_delays(rows: DataFrame) -> DataFrame:
    return rows.select("k", "status", P.retry_delay(F.col("k"), F.col("status")).alias("delay"))


SITES = Fixture("domain string, name string, priority int", (("a", "Site A", 1), ("c", None, 2)))
on_fixture(
    "frontier_sources",
    "SELECT domain, coalesce(name, domain) AS name, coalesce(priority, 9) AS priority FROM (SELECT DISTINCT domain FROM {0}) LEFT JOIN {1} USING (domain)",
    FRONTIER, SITES
)(lambda f, c: P.named_sources(f.select("domain").distinct(), c))
PROBES = Fixture(
    "domain string, fetched long, extracted long, chars long",
    (("a", 20, 7, 900), ("b", 20, 1, 400_000), ("c", 0, 0, 0), ("d", 9, 3, 300_000))
)
on_fixture(
    "domain_verdicts",
    "SELECT *, CASE WHEN rate >= 0.35 OR est_tokens >= 100000 THEN 'seed' ELSE 'skip' END AS verdict FROM (SELECT domain, round(coalesce(extracted / nullif(fetched, 0), 0), 4) AS rate, CAST(floor(chars / 3.15::DOUBLE) AS BIGINT) AS est_tokens FROM {0})",
    PROBES
)(P.domain_verdict)

# ---- payloads of the web; what they hold is written out on the other side
PAYLOADS = Fixture("body string", (
    ("<sitemapindex><sitemap><loc>http://a/s1.xml</loc></sitemap><sitemap><loc> http://a/s2.xml.gz </loc></sitemap></sitemapindex>",),
    ('<urlset xmlns:n="x"><url><loc>http://a/x</loc></url><url><loc>http://a/x</loc></url><n:url><n:loc>http://a/y</n:loc></n:url></urlset>',),
    ("<rss><channel><item><link><![CDATA[http://a/post]]></link></item></channel>",),
))
on_fixture(
    "web_sitemaps",
    "SELECT * FROM (VALUES ('http://a/s1.xml', true), ('http://a/s2.xml.gz', true), ('http://a/x', false), ('http://a/y', false), ('http://a/post', false)) v(link, nested)",
    PAYLOADS
)(lambda p: W.sitemap_links(p).select("link", "nested"))
ROBOTS = Fixture(
    "host string, body string",
    (
        (
            "h",
            "User-agent: *\nDisallow: /private\nAllow: /private/ok\nSITEMAP: http://h/a.xml\n\nUser-agent: other\nDisallow: /\nSitemap: http://h/b.xml"
        ),
        ("g", "User-agent: *\nDisallow: /")
    )
)
URLS = Fixture(
    "url string",
    (("http://h/private/x",), ("http://h/private/ok/1",), ("http://h/z",), ("http://g/any",), ("http://other/private",))
)
on_fixture(
    "web_robots_sitemaps", "SELECT * FROM (VALUES ('http://h/a.xml'), ('http://h/b.xml')) v(link)", ROBOTS
)(W.robots_sitemaps)
on_fixture(
    "web_allowed", "SELECT url, url NOT IN ('http://h/private/x', 'http://g/any') AS allowed FROM {1}", ROBOTS, URLS
)(lambda r, u: W.allowed(u, W.robots_rules(r)))
WIKI = Fixture("body string", (
    ('{"continue": {"apcontinue": "Next page"}, "query": {"allpages": [{"title": "A b"}, {"title": "Émile"}]}}',),
    ('{"query": {"allpages": [{"title": "Z"}]}}',),
))
on_fixture(
    "web_wiki_titles",
    "SELECT * FROM (VALUES ('http://w/wiki/A_b', 'A b'), ('http://w/wiki/%C3%89mile', 'Émile'), ('http://w/wiki/Z', 'Z')) v(url, title)",
    WIKI
)(lambda p: W.wiki_titles(p, "http://w/wiki/").withColumn("title", W.title_of(F.col("url"))))
on_fixture("web_wiki_next", "SELECT 'Next page' AS next", WIKI)(lambda p: W.wiki_next(p).filter("next IS NOT NULL"))
EXTRACTS = Fixture(
    "body string",
    (
        (
            '{"query": {"pages": {"1": {"title": "T", "extract": "' + "long enough " * 20 + '"}, "2": {"title": "S", "extract": "short"}}}}',
        ),
    )
)
on_fixture(
    "web_wiki_texts", "SELECT 'T' AS title, CAST(240 AS INT) AS n", EXTRACTS
)(lambda p: W.wiki_texts(p).select("title", F.length("text").alias("n")))
on_fixture(
    "web_blog_posts", "SELECT * FROM (VALUES ('http://b/1'), ('http://b/2')) v(url)",
    Fixture("body string", (('[{"link": "http://b/1"}, {"link": "http://b/2"}]',), ("[]",)))
)(W.blog_posts)
LINKS = Fixture("source string, target string", (("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("a", "r")))
on_fixture(
    "web_link_crawl", "SELECT * FROM (VALUES ('r', 0), ('a', 1), ('b', 1), ('c', 2)) v(url, depth)", LINKS
)(lambda links: W.link_crawl(links.filter("source = 'r'").select(F.col("source").alias("url")), links))
FOUND = Fixture("strategy int, url string", ((1, "u1"), (1, "u2"), (2, "u2"), (2, "u3"), (3, "u4")))
on_fixture(
    "web_discovered",
    "SELECT url, min(strategy) AS rank FROM (SELECT * FROM {0} WHERE strategy < 3) GROUP BY url",
    FOUND,
)(lambda f: W.discovered([(k, f.filter(F.col("strategy") == k)) for k in (1, 2, 3)], most=10, enough=3).select("url", "rank"))
on_fixture(
    "web_archive", "SELECT url, substr(md5(url), 1, 2) || '/' || md5(url) || '.html.gz' AS path FROM {0}", URLS
)(lambda u: u.select("url", W.archive_path(F.col("url")).alias("path")))


@query(
    "html_titles",
    r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages"
)
def html_titles(spark, d):
    return t(spark, d, "pages").select(
        "page_id",
        F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")).alias("title")
    )


# ---- stages, shares, perplexity
RAW = Fixture("lang string, kind string, docs long", (("hi", "manual", 100), ("hi", "downloaded", 900), ("ne", "manual", 50)))
FINAL = Fixture("lang string, kind string, docs long", (("hi", "manual", 60), ("hi", "manual", 10), ("ne", "downloaded", 20)))
on_fixture(
    "stage_table",
    "SELECT lang, kind, coalesce(CAST(r.docs AS VARCHAR), 'not reported') AS raw, coalesce(CAST(f.docs AS VARCHAR), 'not reported') AS final FROM (SELECT lang, kind, sum(docs)::BIGINT AS docs FROM {0} GROUP BY ALL) r FULL JOIN (SELECT lang, kind, sum(docs)::BIGINT AS docs FROM {1} GROUP BY ALL) f USING (lang, kind)",
    RAW, FINAL,
)(lambda a, b: P.stage_table([("raw", a), ("final", b)]))


@query(
    "split_shares",
    f"WITH s AS (SELECT coalesce(split, 'total') AS split, CAST(sum(strlen(text)) AS BIGINT) AS bytes, sum(CASE WHEN source_type = 'manual' THEN strlen(text) ELSE 0 END) AS manual FROM ({_ASSIGNED}) GROUP BY GROUPING SETS ((split), ())) SELECT split, bytes, round(100 * bytes / max(bytes) OVER (), 2) AS share, round(100 * manual / bytes, 2) AS manual_share FROM s",
)
def split_shares(spark, d):
    return P.split_shares(
        _assigned(spark, d).select("split", "source_type", F.octet_length("text").cast("long").alias("bytes")), "bytes"
    )


@query(
    "source_totals",
    f"SELECT source, {_TYPE} AS source_type, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((source), (source_type), ())".replace(
        "GROUP BY GROUPING SETS", "GROUP BY GROUPING SETS"
    )
)
def source_totals(spark, d):
    rows = _assigned(spark, d).select("source", "source_type", F.length("text").alias("chars"))
    return rows.groupingSets([["source"], ["source_type"], []], "source", "source_type").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("chars").alias("chars")
    )


_SCORED = f"SELECT p.doc_id, ppl, len({_WORDS}) AS words, length(text) AS chars FROM ({_PPL}) p JOIN documents USING (doc_id)"
BUCKETS = (0.0, 10.0, 50.0, 100.0, 200.0, 500.0)


def _scored(spark, d) -> DataFrame:
    words = t(spark, d, "documents").select(
        "doc_id", F.size(X.words(F.col("text"))).alias("words"), F.length("text").alias("chars")
    )
    return _ppl(spark, d).join(words, "doc_id")


@query(
    "perplexity_buckets",
    "SELECT lo, count(*) AS docs, CAST(sum(words) AS BIGINT) AS words, CAST(floor(sum(chars) / 3.15::DOUBLE) AS BIGINT) AS est_tokens FROM (SELECT *, CASE " + " ".join(
        f"WHEN ppl >= {e} THEN {e}::DOUBLE" for e in reversed(BUCKETS)
    ) + f" END AS lo FROM ({_SCORED})) GROUP BY lo"
)
def perplexity_buckets(spark, d):
    return P.bucketed(_scored(spark, d), "ppl", BUCKETS)


@query(
    "perplexity_kept",
    f"WITH p AS MATERIALIZED (SELECT doc_id, ppl, row_number() OVER (ORDER BY ppl) - 1 AS r, count(*) OVER () AS n FROM ({_PPL})) SELECT doc_id FROM p WHERE ppl <= (SELECT ppl FROM p WHERE r = CAST(floor(n * 0.95::DOUBLE) AS BIGINT))"
)
def perplexity_kept(spark, d):
    """Documents without the outliers above the 95th percentile."""
    scores = _cut(_ppl(spark, d))  # read twice
    cut = K.index_percentiles(scores, "ppl", (0.95,)).first()["ppl"]
    return scores.filter(F.col("ppl") <= cut).select("doc_id")


@query(
    "perplexity_bands",
    f"""WITH s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ppl) - 1 AS r, count(*) OVER () AS n FROM ({_SCORED})),
c AS (SELECT max(ppl) FILTER (r = floor(n * 0.5::DOUBLE)) AS a, max(ppl) FILTER (r = floor(n * 0.9::DOUBLE)) AS b, max(ppl) FILTER (r = floor(n * 0.95::DOUBLE)) AS c
  FROM s)
SELECT CASE WHEN ppl <= a THEN 'ideal' WHEN ppl <= b THEN 'good' WHEN ppl <= c THEN 'mild' ELSE 'remove' END AS band, count(*) AS docs, CAST(sum(words) AS BIGINT) AS words, round(count(*) / max(n), 6) AS share
  FROM s, c GROUP BY band""",
)
def perplexity_bands(spark, d):
    """Documents by the median, the 90th and the 95th percentile."""
    scored = _cut(_scored(spark, d))
    a, b, c = (r["ppl"] for r in K.index_percentiles(scored, "ppl", (0.5, 0.9, 0.95)).orderBy("p").collect())
    x = F.col("ppl")
    band = F.when(x <= a, "ideal").when(x <= b, "good").when(x <= c, "mild").otherwise("remove")
    sums = scored.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("docs"), F.sum("words").alias("words"))
    total = scored.count()
    return sums.withColumn("share", F.round(F.col("docs") / F.lit(total), 6))


# ---- tokenizers and encoded texts
ENCODED = Fixture("id long, text string, pieces array<string>", (
    (1, "hello world", ("▁he", "llo", "▁world")), (2, "aà x", ("▁a", "<0xC3>", "<0xA0>", "▁x")), (3, "tab\there", ("▁tab", "<0x09>", "here")), (4, "odd", ("<unk>",)), (5, "", ()),
))
on_fixture(
    "tokenizer_report",
    r"""WITH s AS (SELECT count(*) AS docs, sum(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')))::BIGINT AS words, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, sum(len(pieces))::BIGINT AS tokens,
  sum(len(list_filter(pieces, lambda p: p = '<unk>')))::BIGINT AS unk, sum(len(list_filter(pieces, lambda p: regexp_matches(p, '^<0x[0-7][0-9A-F]>$'))))::BIGINT AS ascii_fallback, sum(len(list_filter(pieces, lambda p: regexp_matches(p, '^<0x[89A-F][0-9A-F]>$'))))::BIGINT AS other_fallback FROM {0})
SELECT *, round(tokens / words, 2) AS fertility, round(chars / tokens, 2) AS compression, round(bytes / tokens, 4) AS bytes_per_token, round(100 * unk / tokens, 4) AS unk_pct, round(100 * ascii_fallback / tokens, 4) AS ascii_fallback_pct, round(100 * other_fallback / tokens, 4) AS other_fallback_pct
  FROM s""".replace("{0}", "{0}"),
    ENCODED,
)(lambda e: K.tokenizer_report(e.select(F.col("id").alias("doc_id"), "pieces"), e.select(F.col("id").alias("doc_id"), "text")))
on_fixture(
    "text_tokens",
    r"SELECT *, round(coalesce(tokens / nullif(words, 0), 0), 2) AS per_word, round(coalesce(chars / nullif(tokens, 0), 0), 2) AS chars_a_token FROM (SELECT id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT AS words, length(text)::BIGINT AS chars, len(pieces)::BIGINT AS tokens, array_to_string(pieces, ' ') AS joined FROM {0})",
    ENCODED,
)(P.text_tokens)
PIECES = Fixture(
    "model string, piece string",
    (
        ("unigram_8000", "▁a"), ("unigram_8000", "b"), ("unigram_8000", "▁the"), ("unigram_10000", "▁"), ("unigram_10000", "ing"),
        ("bpe_10000", "x")
    )
)
on_fixture(
    "vocabulary_report",
    "SELECT model, size, single, size * 512 AS embedding, round(size * 512 / 25000000, 6) AS share FROM (SELECT model, count(*) AS size, round(avg(CASE WHEN length(replace(piece, '▁', '')) = 1 THEN 1 ELSE 0 END), 4) AS single FROM {0} GROUP BY model)",
    PIECES
)(lambda p: P.vocabulary_report(p, 512, 25_000_000))
on_fixture("preferred_model", "SELECT 'unigram_10000' AS model", PIECES)(
    lambda p: P.preferred(p.select("model").distinct(), ("unigram_10000", "unigram_8000", "bpe_10000", "bpe_8000"))
)
MODELS = Fixture("model string, vocab long", (("unigram_8000", 3), ("unigram_10000", 2), ("bpe_10000", 1)))
on_fixture("vocabulary_guard", "SELECT model, vocab FROM {0}", MODELS, PIECES)(
    lambda m, p: P.consistent(m, p.groupBy("model").agg(F.count(F.lit(1)).alias("size")))
)
on_fixture(
    "run_settings",
    "SELECT vocab, train_tokens // tokens_a_step AS max_steps, CAST(round((train_tokens // tokens_a_step) * 0.018::DOUBLE / 10) * 10 AS BIGINT) AS warmup FROM {0}",
    Fixture("vocab long, train_tokens long, tokens_a_step long", ((5000, 450_667_252, 16_384), (8000, 453_282_358, 16_384)))
)(P.run_settings)
CONFIGS = Fixture("kind string", (("bpe",), ("unigram",)))
on_fixture(
    "tokenizer_grid",
    r"SELECT kind, vocab, count(*) AS docs, sum(len(pieces))::BIGINT AS tokens FROM {0}, (VALUES (5000::BIGINT), (8000), (10000)) v(vocab), {1} GROUP BY ALL",
    CONFIGS, ENCODED,
)(lambda c, e: c.withColumn("vocab", F.explode(F.array(*(F.lit(v).cast("long") for v in (5000, 8000, 10000))))).crossJoin(e.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("pieces")).alias("tokens"))))  # fmt: skip  # six settings, one row


@query("token_accounts")
def token_accounts(spark, d):
    """Real tokens by split and source type, with an end token for each document, and bytes a token."""
    import public_tokenizers

    docs = _assigned(spark, d).select("split", "source_type", F.octet_length("text").alias("bytes"), "text")
    rows = K.token_numbers(docs, public_tokenizers.path("piece_bpe_32k.model"))
    sums = rows.groupBy("split", "source_type").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("bytes").alias("bytes"), F.sum("tokens").cast("long").alias("tokens")
    )
    return sums.withColumn("bytes_per_token", F.round(F.col("bytes") / F.col("tokens"), 4))


@query(
    "token_file",
    "SELECT doc_id, start AS start, CAST(w AS INT) AS id FROM (SELECT doc_id, unnest(range(0, len(w))) AS start, unnest(list_transform(w, lambda x: length(x) * 37 % 65536)) AS w FROM (SELECT doc_id, " + _WORDS + " AS w FROM documents))"
)
def token_file(spark, d):
    """Ids (word lengths times 37) written as 16-bit little-endian bytes and read back."""
    ids = t(spark, d, "documents").select("doc_id", word_numbers("text").alias("ids"))
    path = folder(spark)
    T.write_tokens(ids, path)
    read = T.read_tokens(spark, path)
    return read.select("doc_id", F.posexplode("ids").alias("start", "id")).withColumn("start", F.col("start").cast("long"))


@query(
    "replay_mix",
    "SELECT 'task' AS kind, count(*) AS n FROM labels UNION ALL SELECT 'replay', least((SELECT count(*) FROM documents), (SELECT ceil(count(*) / 4) FROM labels)::BIGINT)"
)
def replay_mix(spark, d):
    tasks, corpus = (t(spark, d, x).select(F.col("doc_id").alias("id")) for x in ("labels", "documents"))
    mixed = P.replayed(tasks, corpus, 4)
    return mixed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


HISTORY = Fixture("id long, h array<int>", ((1, (1, 2, 3, 1, 2)), (2, (1, 1, 1)), (3, (5,)), (4, (4, 5, 4, 5, 4))))
on_fixture("banned_ngrams", "SELECT * FROM (VALUES (1::BIGINT, '3'), (2, '1'), (3, ''), (4, '4')) v(id, banned)", HISTORY)(
    lambda h: h.select("id", F.array_join(K.banned_ngrams(F.slice("h", F.lit(1), F.when(F.col("id") == 4, 4).otherwise(F.size("h"))), 3), ",").alias("banned"))
)
on_fixture("position_matches", "SELECT * FROM (VALUES (1::BIGINT, '0,3'), (2, ''), (3, ''), (4, '')) v(id, places)", HISTORY)(
    lambda h: h.select("id", F.array_join(K.position_matches(F.col("h"), F.array(F.lit(1), F.lit(2))), ",").alias("places"))
)

# ---- answers and rules
SAID = Fixture("item long, category string, split string, said string, answer string, candidates array<string>, first_named string, last_named string", (
    (1, "direct", "train", "Asha", "Asha", ("Asha", "Bina"), "Asha", "Bina"), (2, "direct", "train", "Bina.", "Bina", ("Asha", "Bina"), "Bina", "Asha"), (3, "direct", "test", "Asha।", "Asha", ("Asha", "Bina"), "Asha", "Bina"),
    (4, "direct", "test", "Binaको है", "Bina", ("Asha", "Bina"), "Asha", "Bina"), (5, "chain", "train", "nobody", "Dev", ("Dev", "Esha"), "Esha", "Dev"), (6, "chain", "test", "Deva", "Dev", ("Dev", "Esha"), "Esha", "Dev"),
    (7, "chain", "test", "", "Esha", ("Dev", "Esha"), "Esha", "Dev"), (8, "chain", "test", "Eshaले", "Dev", ("Dev", "Esha"), "Dev", "Esha"),
))
ENDINGS = ("ले", "को", "से")
_WORD = "rtrim(coalesce(list_filter(string_split(said, ' '), lambda w: w <> '')[1], ''), '।,.')"
_STEM = f"CASE WHEN regexp_extract({_WORD}, '^(.+?)(?:{'|'.join(ENDINGS)})$', 1) <> '' THEN regexp_extract({_WORD}, '^(.+?)(?:{'|'.join(ENDINGS)})$', 1) ELSE {_WORD} END"
on_fixture(
    "answer_rates",
    f"SELECT category, count(*) AS n, round(avg((w = answer)::INT), 4) AS strict, round(avg((w = answer OR s = answer)::INT), 4) AS tolerant, round(avg((list_contains(candidates, w) OR list_contains(candidates, s))::INT), 4) AS named, round(avg((NOT (list_contains(candidates, w) OR list_contains(candidates, s)))::INT), 4) AS invalid FROM (SELECT *, {_WORD} AS w, {_STEM} AS s FROM {{0}}) GROUP BY category",
    SAID,
)(lambda r: P.answer_rates(r, ENDINGS))
on_fixture(
    "wrong_examples", f"SELECT item, said, answer FROM {{0}} WHERE {_WORD} <> answer ORDER BY item LIMIT 10", SAID
)(P.wrong_examples)
on_fixture(
    "rule_halves",
    "WITH l AS (SELECT item, category, split, said, answer, unnest(['first_named', 'last_named']) AS rule, unnest([first_named, last_named]) AS guess FROM {0}), a AS (SELECT category, rule, avg((guess = answer)::INT) AS a FROM l WHERE split = 'train' GROUP BY ALL), b AS (SELECT category, arg_max(rule, struct_pack(a := a, r := rule)) AS rule FROM a GROUP BY category) SELECT category, rule, CASE WHEN guess = answer THEN 'right' ELSE 'wrong' END AS half, count(*) AS n, round(avg((said = answer)::INT), 4) AS accuracy FROM l JOIN b USING (category, rule) WHERE split = 'test' GROUP BY ALL",
    SAID,
)(lambda r: P.rule_halves(r, ["first_named", "last_named"]))
EDITS = Fixture(
    "answer string, original string, edited string, edited_answer string",
    (("A", "A", "B", "B"), ("A", "A", "A", "B"), ("B", "A", "A", "A"), ("B", "A", "A", "B"))
)
on_fixture(
    "probe_summary",
    "SELECT count(*) AS n, round(avg((original = answer)::INT), 4) AS original, round(avg((edited = edited_answer)::INT), 4) AS edited, round(avg(((original = answer) = (edited = edited_answer))::INT), 4) AS consistent FROM {0}",
    EDITS
)(R.probe_summary)
QUESTIONS = Fixture(
    "id long, text string", ((1, "Asha को 5 sangtare और Binaले the house"), (2, "the big river 12km from Asha"), (3, ""))
)
on_fixture(
    "skeletons",
    "SELECT * FROM (VALUES (1::BIGINT, '<N> को 5 sangtare और <N>ले the house'), (2, 'the big river 12km from <N>'), (3, '')) v(id, skeleton)",
    QUESTIONS
)(lambda q: q.select("id", P.skeleton(F.col("text"), ["Asha", "Bina"]).alias("skeleton")))
on_fixture("content_words", "SELECT * FROM (VALUES (1::BIGINT, 'Asha Binaले house'), (2, 'Asha big from'), (3, '')) v(id, words)", QUESTIONS)(
    lambda q: q.select("id", F.array_join(F.array_sort(P.content_words(F.col("text"), ("the", "and"))), " ").alias("words"))
)
on_fixture(
    "prompt_lines", "SELECT * FROM (VALUES ('who is older?', 'A|B'), ('no candidates', '')) v(prompt, candidates)",
    Fixture("value string", (("# a note",), ("",), ("who is older? | A, B",), ("  no candidates ",)))
)(lambda p: T.prompts(p).select("prompt", F.array_join("candidates", "|").alias("candidates")))
on_fixture("run_specs", "SELECT * FROM (VALUES ('full', 7::BIGINT), ('no-rope', 0)) v(name, seed)", Fixture("spec string", (("full@7",), ("no-rope",))))(
    lambda s: s.select(F.split_part("spec", F.lit("@"), F.lit(1)).alias("name"), F.coalesce(F.try_to_number(F.nullif(F.split_part("spec", F.lit("@"), F.lit(2)), F.lit("")), F.lit("999")).cast("long"), F.lit(0).cast("long")).alias("seed"))
)
on_fixture("choice_aliases", "SELECT * FROM (VALUES ('1', 'hi'), ('2', 'ne'), ('3', 'both'), ('BOTH', 'both'), ('x', NULL)) v(given, choice)", Fixture("given string", (("1",), ("2",), ("3",), ("BOTH",), ("x",))))(
    lambda g: g.select("given", F.when(F.lower("given").isin("1", "hi"), "hi").when(F.lower("given").isin("2", "ne"), "ne").when(F.lower("given").isin("3", "both"), "both").alias("choice"))
)

# ---- runs, curves, attention
RUNS = Fixture(
    "lang string, run string, written double, choice double",
    (("hi", "a", 0.33, 0.4), ("hi", "b", 0.33, 0.5), ("ne", "a", 0.1, 0.9), ("ne", "c", 0.2, 0.1))
)
on_fixture(
    "best_run", "SELECT lang, arg_max(run, struct_pack(w := written, c := choice, r := run)) AS run FROM {0} GROUP BY lang", RUNS
)(P.best_run)
CURVE = Fixture(
    "run string, step long, loss double, val_loss double, seconds double",
    (
        ("a", 0, 9.0, None, 0.0), ("a", 100, None, 5.0, 80.0), ("a", 200, 4.0, None, 155.0), ("a", 300, None, 4.5, 240.0),
        ("a", 400, None, 4.5, 320.0), ("b", 100, None, 6.0, 10.0)
    )
)
on_fixture(
    "best_checkpoint",
    "SELECT run, arg_min(step, struct_pack(v := val_loss, s := step)) AS step, min(val_loss) AS val_loss FROM {0} WHERE val_loss IS NOT NULL GROUP BY run",
    CURVE
)(lambda c: P.best_checkpoint(c))
on_fixture(
    "throughput",
    "SELECT run, step, round((step - lag(step) OVER w) * 16384 / (seconds - lag(seconds) OVER w), 2) AS rate FROM {0} WINDOW w AS (PARTITION BY run ORDER BY step)",
    CURVE
)(lambda c: P.throughput(c, 16_384))
on_fixture(
    "training_rows", "SELECT run, step, loss FROM {0} WHERE loss IS NOT NULL", CURVE
)(lambda c: c.filter("loss IS NOT NULL").select("run", "step", "loss"))
on_fixture(
    "sweet_spot",
    "SELECT lang, setting, row_number() OVER (PARTITION BY lang ORDER BY distance, chrf DESC, setting) AS rank FROM {0}",
    Fixture(
        "lang string, setting string, distance double, chrf double",
        (("hi", "T1", 0.1, 20.0), ("hi", "T2", 0.1, 21.0), ("hi", "T3", 0.05, 1.0), ("ne", "T1", 0.5, 3.0))
    )
)(P.sweet_spot)
KNOWN = Fixture("size string, val double, accuracy double", (("5k", 1.0, 0.3), ("10k", 0.9, 0.4)))
NEW = Fixture("size string, val double, accuracy double", (("10k", 0.1, 0.1), ("100k", 0.7, 0.6)))
on_fixture(
    "sweep_merge",
    "SELECT size, regexp_extract(size, '^([0-9]+)k$', 1)::BIGINT * 1000 AS items, val, accuracy FROM (SELECT * FROM {0} UNION ALL SELECT * FROM {1} n WHERE n.size NOT IN (SELECT size FROM {0}))",
    KNOWN, NEW
)(P.merged_sweep)
MASS = Fixture(
    "prompt long, layer int, head int, role string, p double",
    (
        (1, 0, 0, "answer", 0.5), (1, 0, 0, "distractor", 0.25), (1, 0, 1, "answer", 0.1), (1, 0, 1, "answer", 0.2),
        (2, 0, 0, "distractor", 0.4), (2, 0, 0, "other", 0.6), (1, 1, 0, "answer", 0.9), (1, 1, 0, "distractor", 0.1)
    )
)
on_fixture(
    "attention_selectivity",
    "WITH h AS (SELECT layer, prompt, head, sum(p) FILTER (role = 'answer') AS a, sum(p) FILTER (role = 'distractor') AS b FROM {0} GROUP BY ALL), q AS (SELECT layer, prompt, avg(a) AS a, avg(b) AS b FROM h GROUP BY ALL), l AS (SELECT layer, avg(a) AS a, avg(b) AS b FROM q GROUP BY layer) SELECT layer, round(a, 6) AS answer, round(b, 6) AS distractor, round(a / b, 6) AS ratio FROM l",
    MASS,
)(P.selectivity)
HEADS = Fixture(
    "passage long, layer int, head int, entropy double",
    ((1, 0, 0, 1.0), (2, 0, 0, 3.0), (1, 0, 1, 5.0), (1, 1, 0, 2.5), (2, 1, 0, 2.0))
)
on_fixture(
    "attention_summary",
    "WITH p AS (SELECT layer, head, avg(entropy) AS e FROM {0} GROUP BY ALL) SELECT layer, head, round(avg(e), 6) AS entropy FROM p GROUP BY GROUPING SETS ((layer, head), (layer), ())",
    HEADS
)(P.attention_summary)
on_fixture("attention_kinds", "SELECT layer, head, CASE WHEN entropy <= 2.25 THEN 'sharp' ELSE 'broad' END AS kind FROM (SELECT layer, head, avg(entropy) AS entropy FROM {0} GROUP BY ALL)", HEADS)(
    lambda h: S.head_kinds(h.groupBy("layer", "head").agg(F.avg("entropy").alias("entropy"), F.lit(1.0).alias("distance"))).select("layer", "head", F.split_part("kind", F.lit("-"), F.lit(2)).alias("kind"))
)
METRICS = Fixture(
    "metric string, lang string, value double",
    (("ppl", "hi", 24.4), ("ppl", "ne", 29.9), ("bpb", "hi", 0.47), ("bpb", "ne", 0.46), ("even", "hi", 1.0), ("even", "ne", 1.0))
)
on_fixture(
    "language_comparison",
    "SELECT metric, CASE WHEN h < n THEN 'hi' WHEN n < h THEN 'ne' ELSE 'equal' END AS favours, round(abs(h - n), 6) AS gap FROM (SELECT metric, max(value) FILTER (lang = 'hi') AS h, max(value) FILTER (lang = 'ne') AS n FROM {0} GROUP BY metric)",
    METRICS
)(lambda m: P.favours(m, "hi", "ne"))
on_fixture(
    "template_usage",
    "WITH c AS (SELECT category, count(*) AS n FROM {0} GROUP BY category) (SELECT category, n, 'most' AS \"end\" FROM c ORDER BY n DESC, category LIMIT 1) UNION ALL (SELECT category, n, 'least' FROM c ORDER BY n, category LIMIT 1)",
    SAID
)(lambda r: P.usage(r, "category"))


@query(
    "sources_excluded",
    "SELECT source, count(*) AS n FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src00' OR ends_with(source, '0')) GROUP BY source"
)
def sources_excluded(spark, d):
    """Texts that no training source (here: those whose name ends in 0) holds."""
    docs = t(spark, d, "documents").withColumn("h", F.md5("text"))
    return R.disjoint(
        docs, docs.filter("source = 'src00' OR endswith(source, '0')"), "h"
    ).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ingested",
    "SELECT count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, max('downloaded') AS source_type FROM documents WHERE length(text) >= 200"
)
def ingested(spark, d):
    """A dataset's rows that are long enough, with their count and size."""
    rows = T.ingest(t(spark, d, "documents"), "public", "en", url_key="source")
    return rows.agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"), F.max("source_type").alias("source_type")
    )


@query("content_ids", None)
def content_ids(spark, d):
    """Content hashes as a document's id and as a bucket."""
    from ..functions.python_udfs import blake2b_32, blake2b_64

    return t(spark, d, "documents").select(
        "doc_id", blake2b_64("text").alias("content_id"), (blake2b_32("text") % 100).alias("bucket")
    )


@query(
    "sentence_lines",
    r"SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.?!])', '\1' || chr(30), 'g'), chr(30)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: length(s) >= 10))::BIGINT AS n FROM documents"
)
def sentence_lines(spark, d):
    """A tokenizer's training sample: sentences of ten characters or more."""
    own = F.filter(X.sentences(F.col("text"), ".?!"), lambda s: F.length(s) >= 10)
    return t(spark, d, "documents").select("doc_id", F.size(own).cast("long").alias("n"))


# ---- sinks and readers, by what comes back
@query("quarantine_counts", "SELECT length(text) >= 200 AS accepted, count(*) AS docs FROM documents GROUP BY ALL")
def quarantine_counts(spark, d):
    """Kept and rejected rows in two places."""
    docs = t(spark, d, "documents").select("doc_id", "text").withColumn("accepted", F.length("text") >= 200)
    path = folder(spark)
    T.write_quarantine(docs, f"{path}/kept", f"{path}/rejected")
    both = [spark.read.parquet(f"{path}/{x}").select(F.lit(x == "kept").alias("accepted")) for x in ("kept", "rejected")]
    return both[0].unionByName(both[1]).groupBy("accepted").agg(F.count(F.lit(1)).alias("docs"))


@query(
    "csv_and_report",
    "SELECT 'csv' AS kind, r_regionkey AS key, r_name AS name FROM region UNION ALL SELECT 'report', r_regionkey, r_name FROM region"
)
def csv_and_report(spark, d):
    rows, path = t(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), folder(spark)
    T.write_csv(rows, f"{path}/csv")
    T.write_report(rows, f"{path}/report")
    kind = rows.schema
    read = [
        ("csv", spark.read.schema(kind).option("header", "true").csv(f"{path}/csv")),
        ("report", T.report_or_empty(spark, f"{path}/report", kind)), ("none", T.report_or_empty(spark, f"{path}/missing", kind))
    ]
    frames = [df.select(F.lit(k).alias("kind"), "key", "name") for k, df in read]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("fallback_input", "SELECT 'raw' AS stage, count(*) AS docs FROM region")
def fallback_input(spark, d):
    """The first of several folders that holds files: cleaned documents, or raw ones where there are none."""
    path = folder(spark)
    t(spark, d, "region").write.parquet(f"{path}/raw")
    stage = T.first_with_files(spark, [f"{path}/clean", f"{path}/raw"])
    return spark.read.parquet(stage).agg(F.lit(stage.rsplit("/", 1)[1]).alias("stage"), F.count(F.lit(1)).alias("docs"))


@query(
    "training_sample",
    r"SELECT count(*) AS n FROM (SELECT unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.?!])', '\1' || chr(30), 'g'), chr(30)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: length(s) >= 10)) FROM documents)"
)
def training_sample(spark, d):
    """A tokenizer's training text, a sentence a line; a second run leaves it as it is."""
    path = folder(spark)
    for _ in range(2):
        T.write_sample(t(spark, d, "documents"), path)
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n"))


@query("shards_in_order", "SELECT count(*) AS docs, 0::BIGINT AS wrong FROM documents")
def shards_in_order(spark, d):
    """Shards sorted by doc_id: pairs of neighbours in a file that are not in order."""
    path = folder(spark)
    T.write_sorted(t(spark, d, "documents").select("doc_id", "source"), path, ["doc_id"])
    rows = spark.read.parquet(path).select(
        "doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("m")
    )
    before = F.lag("doc_id").over(Window.partitionBy("file").orderBy("at", "m"))
    return rows.select((before > F.col("doc_id")).alias("wrong")).agg(
        F.count(F.lit(1)).alias("docs"), F.count(F.when(F.col("wrong"), 1)).alias("wrong")
    )


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at FROM events")
def iso_times(spark, d):
    return t(spark, d, "events").select("event_id", X.iso_seconds(F.col("ts")).alias("at"))


@query(
    "full_batches",
    f"SELECT source, (sum(len(w)) - 1)::BIGINT // (4 * 64) AS steps FROM (SELECT source, {_WORDS} AS w FROM documents) GROUP BY source"
)
def full_batches(spark, d):
    """Whole steps of a full evaluation: batches of 4 windows of 64 tokens."""
    n = t(spark, d, "documents").groupBy("source").agg(F.sum(F.size(X.words(F.col("text")))).alias("n"))
    return n.select("source", F.expr("(n - 1) div (4 * 64)").alias("steps"))


PREDICTED = Fixture(
    "source string, lang string, pred string, conf double",
    (("s", "hi", "hi", 0.99), ("s", "hi", "ne", 0.95), ("s", "hi", "hi", 0.5), ("t", "hi", "hi", 0.91))
)
on_fixture(
    "langid_contamination",
    "SELECT source, count(*) AS total, round(1 - avg((pred = 'hi')::INT), 4) AS contamination FROM {0} GROUP BY source", PREDICTED
)(lambda p: L.contamination(p, "hi"))
on_fixture(
    "langid_accepted", "SELECT source, count(*) AS n FROM {0} WHERE pred = lang AND conf >= 0.9 GROUP BY source", PREDICTED
)(lambda p: p.filter(L.accepted(p, F.col("lang"))).groupBy("source").agg(F.count(F.lit(1)).alias("n")))


@on_fixture(
    "final_report",
    "SELECT (SELECT sum(docs)::BIGINT FROM {0}) AS raw, (SELECT sum(docs)::BIGINT FROM {1}) AS final, (SELECT count(DISTINCT model) FROM {2}) AS models, round((SELECT sum(docs) FROM {1}) / (SELECT sum(docs) FROM {0}), 4) AS retention",
    RAW, FINAL, PIECES,
)
def final_report(raw: DataFrame, final: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row of one-row parts."""
    parts = raw.agg(F.sum("docs").alias("raw")).crossJoin(final.agg(F.sum("docs").alias("final"))).crossJoin(
        pieces.agg(F.countDistinct("model").alias("models"))
    )
    return parts.select("*", F.round(F.col("final") / F.col("raw"), 4).alias("retention"))


@query(
    "quota_items",
    "SELECT category, CASE category WHEN 'direct' THEN 30 WHEN 'ranking' THEN 10 ELSE 20 END::BIGINT AS n, true AS distinct_texts FROM (VALUES ('direct'), ('three'), ('ranking')) v(category)"
)
def quota_items(spark, d):
    """Items by category quotas, different texts only."""
    items = R.with_quotas(R.generated(spark, 3000, seed=5), {"direct": 30, "three": 20, "ranking": 10})
    return items.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), (F.countDistinct("text") == F.count(F.lit(1))).alias("distinct_texts")
    )


@query("rewritten_items", "SELECT count(*) AS items, 0::BIGINT AS wrong FROM range(900)")
def rewritten_items(spark, d):
    """Names exchanged one to one: answers stay among the candidates, places and skeletons stay as they were."""
    items = R.generated(spark, 900)
    mapping = dict(zip(R.NAMES, R.NAMES[1:] + R.NAMES[:1], strict=True))
    both = items.select(
        "item", F.col("text").alias("old"), F.col("answer_position").alias("place")
    ).join(R.renamed(items, mapping), "item")
    kept = (F.array_position("candidates", F.col("answer")) - 1 == F.col("place")) & (
        P.skeleton(F.col("old"), R.NAMES) == P.skeleton(F.col("text"), R.NAMES)
    )
    return both.agg(F.count(F.lit(1)).alias("items"), F.count(F.when(~kept, 1)).alias("wrong"))


@query("fresh_names", "SELECT count(*) AS items, 0::BIGINT AS known FROM range(300)")
def fresh_names(spark, d):
    """Items of names and numbers that the training pool lacks."""
    items = R.generated(spark, 300, seed=9, names="Abel Bruno Carl Doris Edith Franz Gerda Hanna".split(), numbers=(60, 90))
    return items.agg(
        F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("text").rlike(rf"\b(?:{'|'.join(R.NAMES)})\b"), 1)).alias("known")
    )


@query("web_payloads", "SELECT * FROM (VALUES (1::BIGINT, 'http://a/z'), (2, 'plain')) v(id, link)")
def web_payloads(spark, d):
    """Sitemaps as files: packed or not."""
    packed = base64.b64encode(gzip.compress(b"<urlset><url><loc>http://a/z</loc></url></urlset>", mtime=0)).decode()
    plain = base64.b64encode(b"<urlset><loc>plain</loc></urlset>").decode()
    rows = spark.createDataFrame([(1, packed), (2, plain), (3, None)], "id long, raw string")
    body = rows.select("id", payload(F.unbase64("raw")).alias("body"))
    one = F.regexp_extract("body", "<loc>([^<]+)</loc>", 1)
    return body.filter("body IS NOT NULL").select("id", one.alias("link"))


@query("split_manifests", f"SELECT split, count(*) AS docs FROM ({_ASSIGNED}) GROUP BY split")
def split_manifests(spark, d):
    """Ids of each split written as text, none empty, read back and met with the documents again."""
    rows, path = _assigned(spark, d).select("split", "doc_id"), folder(spark)
    T.write_manifests(rows, path)
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    found = None
    for name in ("train", "val", "test"):
        own = docs.join(T.read_manifest(spark, f"{path}/split={name}"), "doc_id", "left_semi")
        n = own.agg(F.lit(name).alias("split"), F.count(F.lit(1)).alias("docs"))
        found = n if found is None else found.unionByName(n)
    return C.assert_no_empty_split(found)


@query("dedup_counts", _GREEDY.replace("SELECT doc_id FROM u WHERE", "SELECT (SELECT count(*) FROM documents) AS seen, (SELECT count(*) FROM documents) - (SELECT count(*) FROM u) AS exact, (SELECT count(*) FROM u) - count(*) AS near, count(*) AS kept FROM u WHERE"))
def dedup_counts(spark, d):
    """Rows seen, exact copies, near copies and what is kept."""
    seen = t(spark, d, "documents").agg(F.count(F.lit(1)).alias("seen"))
    different = t(spark, d, "documents").select(F.md5("text").alias("h")).distinct().agg(F.count(F.lit(1)).alias("different"))
    kept = lsh_greedy_keep(spark, d).agg(F.count(F.lit(1)).alias("kept"))
    row = seen.crossJoin(different).crossJoin(kept)  # one row each
    return row.select("seen", (F.col("seen") - F.col("different")).alias("exact"), (F.col("different") - F.col("kept")).alias("near"), "kept")


@query("html_bodies", "SELECT page_id, coalesce(regexp_extract(html, '<article>([^<]*)</article>', 1), '') <> '' AS own FROM pages")
def html_bodies(spark, d):
    """An extractor of one's own before the usual one."""
    primary = lambda html: F.nullif(F.regexp_extract(html, "<article>([^<]*)</article>", 1), F.lit(""))
    pages = t(spark, d, "pages")
    text = W.body_text(F.col("html"), primary)
    return pages.select("page_id", F.coalesce(text.eqNullSafe(primary(F.col("html"))) & primary(F.col("html")).isNotNull(), F.lit(False)).alias("own"))


# ---- single steps on literal rows
on_fixture(
    "frontier_claimed", "SELECT url FROM {0} WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY attempts, url) <= 1", FRONTIER
)(lambda f: C.claimed(f, 1).select("url"))
FRESH = Fixture("url string, domain string, status string, attempts int, n_chars long", (
    ("http://a/1", "a", "pending", 0, None), ("http://d/1", "d", "pending", 0, None), ("http://d/1", "d", "pending", 0, None),
))
on_fixture(
    "frontier_upserted", "SELECT url, status FROM {0} UNION ALL SELECT DISTINCT url, status FROM {1} WHERE url NOT IN (SELECT url FROM {0})", FRONTIER, FRESH
)(lambda f, n: C.upsert_absent(f, n, "url").select("url", "status"))
on_fixture(
    "frontier_requeued", "SELECT url, CASE WHEN status = 'claimed' THEN 'pending' ELSE status END AS status FROM {0}", FRONTIER
)(lambda f: requeued(f).select("url", "status"))
SCORES = Fixture("item long, place int, candidate string, logprob double", (
    (1, 0, "x", -1.0), (1, 0, "x", -2.0), (1, 1, "y", -2.5), (2, 0, "x", -1.0), (2, 1, "y", -1.0), (3, 1, "z", -4.0),
))
on_fixture(
    "forced_choices",
    "SELECT item, arg_max(candidate, struct_pack(s := s, p := -place)) AS chosen FROM (SELECT item, place, candidate, sum(logprob) AS s FROM {0} GROUP BY ALL) GROUP BY item",
    SCORES,
)(K.forced_choice)
RATES = Fixture("category string, n long, chance double, first double, last double", (("direct", 400, 0.5, 0.58, 0.54), ("chain", 100, 0.333, 0.4, 0.6)))
on_fixture(
    "shortcut_violations",
    """SELECT category, rule, accuracy, round(chance + greatest(0.05, 3 * sqrt(chance * (1 - chance) / n)), 9) AS bound
FROM (SELECT category, n, chance, unnest(['first', 'last']) AS rule, unnest([first, last]) AS accuracy FROM {0})
WHERE accuracy > chance + greatest(0.05, 3 * sqrt(chance * (1 - chance) / n))""",
    RATES,
)(lambda r: S.violations(r, ["first", "last"]).select("category", "rule", "accuracy", F.round("bound", 9).alias("bound")))
EDITED = Fixture("id long, text string", ((1, "Asha is tall. Bina is old. Who is tall?"), (2, "Asha and Asha saw Bina. Who?"), (3, "Who?")))
on_fixture(
    "edited_questions",
    """SELECT * FROM (VALUES (1::BIGINT, 'Bina is old. Asha is tall. Who is tall?', 'Bina is tall. Asha is old. Who is tall?'),
(2, 'Asha and Asha saw Bina. Who?', NULL), (3, 'Who?', NULL)) v(id, reversed, swapped)""",
    EDITED,
)(
    lambda q: q.select(
        "id", R.reversed_facts(F.col("text")).alias("reversed"), R.swapped(F.col("text"), F.lit("Asha"), F.lit("Bina")).alias("swapped")
    )
)


@query("shards_round_trip", "SELECT source, count(*) AS docs FROM documents GROUP BY source")
def shards_round_trip(spark, d):
    """Shards of at most a hundred rows, written in two runs."""
    docs, path = t(spark, d, "documents").select("doc_id", "source"), folder(spark)
    manual = C.source_type(F.col("source")) == "manual"
    for part in (docs.filter(manual), docs.filter(~manual)):
        T.write_shards(part, path, 100)
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
