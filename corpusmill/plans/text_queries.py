"""Corpus queries: normalisation, quality, boilerplate, deduplication, splits, tokens, scores, pages, question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.python_udfs import nfc
from ..operators import corpus as C
from ..operators import reasoning as R
from ..operators import scores as S
from ..operators import tokens as K
from ..registry import query
from ..sources import web as W
from ..sources.tables import table as t
from ..streaming.jobs import stored as _cut

#: Literal rows for steps that the tables never exercise; both sides read the same text.
FIXTURES = {
    1: "a\u200bb\u00adc\u200c", 2: "x\x07y\u00a0\u00a0z\x85", 3: "राम १२३ ||  क | ।।। ॥॥", 4: "  a \t  b  \n\n\n\n c ",
    5: "\u0958 e\u0301 हिन्दी", 6: "पानी है। this is english. ठीक है?\nसब ठीक।"
}


def _quoted(s: str) -> str:
    return "concat(" + ", ".join([f"chr({ord(c)})" for c in s] or ["''"]) + ")"


#: documents and the literal rows, in SQL.
_ALL = "(SELECT doc_id, text FROM documents UNION ALL " + " UNION ALL ".join(
    f"SELECT {-k} AS doc_id, {_quoted(v)} AS text" for k, v in FIXTURES.items()
) + ") a"
_W = X.WHITE.replace("{", "{{").replace("}", "}}")  # of a text that is formatted once
_WORDS = f"list_filter(regexp_split_to_array(text, '[{X.WHITE}]+'), lambda w: w <> '')"
_STRIP = f"regexp_replace(regexp_replace({{}}, '^[{_W}]+', ''), '[{_W}]+$', '')"
_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '')"
_TYPE = r"CASE WHEN CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 5 = 0 THEN 'manual' ELSE 'downloaded' END"


def _all(spark, d) -> DataFrame:
    extra = spark.createDataFrame([(-k, v) for k, v in FIXTURES.items()], "doc_id long, text string")
    return t(spark, d, "documents").select("doc_id", "text").unionByName(extra)


def _mapped(name: str, column, sql: str):
    @query(name, f"SELECT doc_id, md5({sql}) AS h FROM {_ALL}")
    def run(spark, d):
        return _all(spark, d).select("doc_id", F.md5(column(F.col("text"))).alias("h"))


_INVISIBLE = _quoted(X.INVISIBLE)
_mapped("norm_invisible", X.remove_invisible, f"translate(text, {_INVISIBLE}, '')")
_CONTROLS = r"regexp_replace({}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', ' ', 'g')"
_mapped("norm_controls", X.blank_controls, _CONTROLS.format("text"))
_mapped("norm_digits", X.ascii_digits, "translate(text, '०१२३४५६७८९', '0123456789')")
_DANDA = r"regexp_replace(regexp_replace(regexp_replace(replace(text, '||', '॥'), '([ऀ-ॿ \t\n\r\f\x0b])\|', '\1।', 'g'), '।{2,}', '।', 'g'), '॥{2,}', '॥', 'g')"
_mapped("norm_danda", X.repair_danda, _DANDA)
_SPACE = r"regexp_replace(regexp_replace(regexp_replace({}, '[ \t\x{{a0}}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
_mapped("norm_space", X.collapse_space, _SPACE.format("text"))
_mapped("norm_nfc", nfc, "nfc_normalize(text)")
_mapped("norm_plain", X.normalised_plain, _STRIP.format(_SPACE.format(_CONTROLS.format(f"translate(text, {_INVISIBLE}, '')"))))
_SENTENCE = r"list_filter(list_transform(string_split(regexp_replace(p, '([।॥?!])', '\1' || chr(30), 'g'), chr(30)), lambda s: " + _STRIP.format("s") + "), lambda s: s <> '' AND NOT regexp_matches(s, '[a-zA-Z]'))"
_mapped(
    "foreign_sentence_filter", X.drop_foreign_sentences,
    f"CASE WHEN regexp_matches(text, '[a-zA-Z]') THEN array_to_string(list_transform(string_split(text, chr(10)), lambda p: array_to_string({_SENTENCE}, ' ')), chr(10)) ELSE text END"
)


@query(
    "norm_invisible_by_source",
    f"SELECT source, CAST(sum(length(text) - length(translate(text, {_INVISIBLE}, ''))) AS BIGINT) AS n FROM documents GROUP BY source"
)
def invisible_by_source(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.sum(X.invisible_count(F.col("text"))).cast("long").alias("n"))


_GRAMS = "CASE WHEN len(w) >= 6 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [] END"
_MEASURES = rf"""SELECT doc_id, text, source, {_TYPE} AS source_type, length(text) AS chars, strlen(text) AS bytes, {_WORDS} AS w, {_LINES} AS l FROM documents"""
_MEASURED = rf"""SELECT doc_id, source, source_type, text, chars, bytes, len(w) AS words,
CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0 END AS word_len,
CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: contains('.?!', right(x, 1)))) / len(l) ELSE 0 END AS terminal,
CASE WHEN len(w) > 0 THEN (length(text) - length(translate(text, '#…•|©®™', ''))) / len(w) ELSE 1 END AS symbols,
CASE WHEN len(l) < 2 THEN 0 ELSE 1 - len(list_distinct(l)) / len(l) END AS dup_lines,
CASE WHEN len(w) < 6 THEN 0 ELSE 1 - len(list_distinct({_GRAMS})) / (len(w) - 4) END AS dup_grams,
CASE WHEN length(regexp_replace(text, '[^\p{{L}}\p{{M}}]', '', 'g')) > 0 THEN length(regexp_replace(text, '[^\p{{Latin}}]', '', 'g')) / length(regexp_replace(text, '[^\p{{L}}\p{{M}}]', '', 'g')) ELSE 0 END AS script
FROM ({_MEASURES})"""
_REASON = """CASE WHEN contains(left(text, 300), 'JFIF') OR contains(left(text, 300), 'Exif') OR contains(left(text, 300), 'Photoshop') OR contains(left(text, 300), 'XMP') OR contains(left(text, 300), '%PDF') THEN 'image_or_binary_file'
WHEN chars < 200 THEN 'too_short' WHEN script < 0.75 THEN 'low_script_ratio' WHEN word_len < 1.5 OR word_len > 12 THEN 'bad_word_length' WHEN terminal < 0.2 THEN 'no_sentence_terminals'
WHEN symbols > 0.1 THEN 'symbol_heavy' WHEN dup_lines > 0.3 THEN 'duplicate_lines' WHEN dup_grams > 0.2 THEN 'duplicate_ngrams' END"""


@query(
    "document_measures",
    f"SELECT doc_id, chars, bytes, words, round(word_len, 6) AS word_len, round(terminal, 6) AS terminal, round(symbols, 6) AS symbols, round(dup_lines, 6) AS dup_lines, round(dup_grams, 6) AS dup_grams, round(script, 6) AS script FROM ({_MEASURED})"
)
def document_measures(spark, d):
    c = F.col("text")

    rounded = [F.round(f"m.{k}", 6).alias(k) for k in ("word_len", "terminal", "symbols", "dup_lines", "dup_grams")]
    measured = t(spark, d, "documents").select(
        "doc_id", F.length(c).cast("long").alias("chars"), F.octet_length(c).cast("long").alias("bytes"),
        F.round(X.script_ratio(c), 6).alias("script"), X.measured(c).alias("m")
    )
    return measured.select("doc_id", "chars", "bytes", "m.words", *rounded, "script")


@query("reject_reason", f"SELECT doc_id, {_REASON} AS reason FROM ({_MEASURED})")
def reject_reason(spark, d):
    return t(spark, d, "documents").select("doc_id", X.reject_reason(F.col("text")).alias("reason"))


@query(
    "filter_report",
    f"SELECT source, reason, count(*) AS docs FROM (SELECT source, {_REASON} AS reason FROM ({_MEASURED})) GROUP BY ALL"
)
def filter_report(spark, d):
    return C.quality_report(t(spark, d, "documents"))


_SURVIVAL = f"SELECT source, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS kept, round(count(*) FILTER (reason IS NULL) / count(*), 4) AS survival_rate FROM (SELECT source, {_REASON} AS reason FROM ({_MEASURED})) GROUP BY source"


@query("quality_funnel", _SURVIVAL)
def quality_funnel(spark, d):
    return C.survival(t(spark, d, "documents"))


_DF = f"SELECT source, line, count(*) AS df FROM (SELECT source, unnest(list_distinct({_LINES})) AS line FROM documents) WHERE length(line) >= 3 GROUP BY ALL"
_BLOCKED = f"SELECT f.source, f.line, f.df FROM ({_DF}) f JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) s USING (source) WHERE f.df >= greatest(2, CAST(floor(0.01 * n) AS BIGINT))"


@query("boilerplate_frequency", _DF)
def boilerplate_frequency(spark, d):
    return C.line_frequency(t(spark, d, "documents"))


@query("boilerplate_blocklist", _BLOCKED)
def boilerplate_blocklist(spark, d):
    return C.blocklist(t(spark, d, "documents"))


@query(
    "boilerplate_strip",
    f"""WITH b AS ({_BLOCKED}), l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, raw, i FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source = l.source AND b.line = {_STRIP.format("raw")}))
SELECT doc_id, md5(x) AS h FROM (SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) AS x FROM k GROUP BY doc_id) WHERE x <> ''""",
)
def boilerplate_strip(spark, d):
    docs = t(spark, d, "documents")
    return C.without_boilerplate(docs, C.blocklist(docs)).select("doc_id", F.md5("text").alias("h"))


@query(
    "exact_dedup_keep",
    f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY {_TYPE}, doc_id) = 1"
)
def exact_dedup_keep(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), C.source_type(F.col("source")).alias("st"))
    return C.exact_first(docs, "h", ["st", "doc_id"]).select("doc_id")


@query(
    "exact_dup_stats",
    "SELECT count(*) AS seen, CAST(count(*) - count(DISTINCT md5(text)) AS BIGINT) AS exact, count(DISTINCT md5(text)) AS kept FROM documents"
)
def exact_dup_stats(spark, d):
    g = t(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.sum("c").alias("seen"), (F.sum("c") - F.count(F.lit(1))).alias("exact"), F.count(F.lit(1)).alias("kept"))


_SHINGLES = "SELECT doc_id, unnest(list_distinct(list_transform(range(0, greatest(length(text) - 5, 0) + 1, 2), lambda i: substr(text, i + 1, 5)))) AS s FROM documents"
_HASHED = f"SELECT DISTINCT doc_id, CAST(concat('0x', substr(md5(s), 1, 8)) AS BIGINT) % {C.PRIME} AS h FROM ({_SHINGLES})"
_MINS = ", ".join(f"min((h * {a} + {b}) % {C.PRIME}) AS m{i}" for i, (a, b) in enumerate(C.affine(C.PERMUTATIONS)))
_KEYS = " UNION ALL ".join(
    f"SELECT doc_id, {b} AS band, md5(concat_ws(',', {', '.join(f'm{b * C.ROWS + r}' for r in range(C.ROWS))})) AS key FROM sig" for b in range(C.BANDS)
)
_PAIRS = f"WITH sig AS MATERIALIZED (SELECT doc_id, {_MINS} FROM ({_HASHED}) GROUP BY doc_id), keys AS MATERIALIZED ({_KEYS}) SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM keys x JOIN keys y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id"


def _unique(spark, d) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h of the first of each text; doc_id, sig of those with a text), so that no band key is hot for exact
    copies. Texts are read once and never shuffled: signatures of all rows are written, and ids meet."""
    docs = t(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), "text")
    rows = _cut(C.row_signatures(docs))
    first = C.exact_first(docs.select("doc_id", "h"), "h", ["doc_id"])
    return first, _cut(C.merged(rows.join(first, ["doc_id", "h"], "left_semi")))


@query("shingle_counts", f"SELECT doc_id, count(*) AS n FROM ({_SHINGLES}) GROUP BY doc_id")
def shingle_counts(spark, d):
    counts = C.shingle_numbers(t(spark, d, "documents").select("doc_id", "text"))
    return counts.groupBy("doc_id").agg(F.sum("n").alias("n"))


_UNIQUE_PAIRS = _PAIRS.replace("FROM documents", "FROM (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)")


@query("lsh_candidate_pairs", _UNIQUE_PAIRS)
def lsh_candidate_pairs(spark, d):
    return C.candidate_pairs(_unique(spark, d)[1])


_GREEDY = "WITH RECURSIVE " + _UNIQUE_PAIRS.removeprefix("WITH ").replace(
    " SELECT DISTINCT x.doc_id", ", pairs AS MATERIALIZED (SELECT DISTINCT x.doc_id", 1
) + """), u AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text),
n AS (SELECT DISTINCT b AS id FROM pairs), o AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM n),
g(i, dropped) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL SELECT o.i, CASE WHEN EXISTS (SELECT 1 FROM pairs WHERE b = o.id AND NOT list_contains(g.dropped, a))
  THEN list_append(g.dropped, o.id) ELSE g.dropped END FROM g JOIN o ON o.i = g.i + 1)
SELECT doc_id FROM u WHERE NOT list_contains((SELECT dropped FROM g ORDER BY i DESC LIMIT 1), doc_id)"""


@query("lsh_greedy_keep", _GREEDY)
def lsh_greedy_keep(spark, d):
    """Documents of one signature have the same neighbours: only the first of them can be kept, and takes part."""
    first, sig = _unique(spark, d)
    nodes = _cut(sig.groupBy("sig").agg(F.min("doc_id").alias("doc_id")))
    kept = C.greedy_kept(nodes.select("doc_id"), C.candidate_pairs(nodes), _cut)
    return kept.unionByName(first.filter("h IS NULL").select("doc_id"))  # no text, no neighbour


_HALF = "documents WHERE CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 2 = {}"


@query(
    "cross_corpus_drop",
    "SELECT doc_id FROM (SELECT doc_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 2 AS side, md5(text) AS h FROM documents) x WHERE EXISTS (SELECT 1 FROM (SELECT CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 2 AS side, md5(text) AS h FROM documents) y WHERE y.h = x.h AND y.side <> x.side)"
)
def cross_corpus_drop(spark, d):
    """Documents whose text stands in both halves of the sources: both sides' rows."""
    side = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2
    docs = t(spark, d, "documents").select("doc_id", side.alias("side"), F.md5("text").alias("h"))
    both = docs.groupBy("h").agg(F.countDistinct("side").alias("sides")).filter("sides > 1")
    return docs.join(both, "h", "left_semi").select("doc_id")


_SIDES = "sides AS (SELECT doc_id, source, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 2 AS side FROM documents)"
_CROSS = _PAIRS[: _PAIRS.index(" SELECT DISTINCT x.doc_id")].replace("WITH sig", f"WITH {_SIDES}, sig")


@query(
    "cross_corpus_near_drop",
    f"{_CROSS} SELECT DISTINCT x.doc_id FROM keys x JOIN sides a ON a.doc_id = x.doc_id JOIN keys y ON x.band = y.band AND x.key = y.key JOIN sides b ON b.doc_id = y.doc_id WHERE a.side <> b.side"
)
def cross_corpus_near_drop(spark, d):
    """Documents of either half of the sources that share a band with one of the other: what a two-sided drop takes out."""
    return C.cross_met(t(spark, d, "documents").select("doc_id", "text", _side().alias("side")))


@query(
    "cross_corpus_kept",
    f"{_CROSS}, bad AS (SELECT DISTINCT x.doc_id FROM keys x JOIN sides a ON a.doc_id = x.doc_id JOIN keys y ON x.band = y.band AND x.key = y.key JOIN sides b ON b.doc_id = y.doc_id WHERE a.side <> b.side) SELECT side, count(*) AS docs FROM sides WHERE doc_id NOT IN (SELECT doc_id FROM bad) GROUP BY side"
)
def cross_corpus_kept(spark, d):
    """What is left of either half after the drop."""
    docs = t(spark, d, "documents").select("doc_id", _side().alias("side"))
    return docs.join(cross_corpus_near_drop(spark, d), "doc_id", "left_anti").groupBy("side").agg(F.count(F.lit(1)).alias("docs"))


def _side():
    return F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2


@query("cross_collision_pairs", f"""{_CROSS}, pairs AS (SELECT DISTINCT a.doc_id AS ida, b.doc_id AS idb, a.source AS sa, b.source AS sb FROM keys x JOIN sides a ON a.doc_id = x.doc_id AND a.side = 0 JOIN keys y ON x.band = y.band AND x.key = y.key JOIN sides b ON b.doc_id = y.doc_id AND b.side = 1)
SELECT sa || ' <-> ' || sb AS pair, count(*) AS n FROM pairs GROUP BY ALL""")  # fmt: skip
def cross_collision_pairs(spark, d):
    """Band collisions between two halves of the sources (source pairs and counts)."""
    counts = C.cross_counts(t(spark, d, "documents").select("doc_id", "text", "source", _side().alias("side")))
    return counts.select(F.concat_ws(" <-> ", "source_a", "source_b").alias("pair"), "n")


@query(
    "benchmark_contamination",
    f"""WITH g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')) ELSE [] END) AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
b AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')) ELSE [] END) AS g FROM (SELECT item_id, {_WORDS} AS w FROM benchmark))
SELECT item_id, doc_id, count(DISTINCT g) AS shared FROM g JOIN b USING (g) GROUP BY ALL""",
)
def benchmark_contamination(spark, d):
    return C.contaminated(t(spark, d, "documents"), t(spark, d, "benchmark"), 8)


_U = "CAST(concat('0x', substr(md5(concat('lma|', grp)), 1, 15)) AS BIGINT) / 1152921504606846976.0"
_SPLIT = f"SELECT doc_id, source, text, {_TYPE} AS source_type, concat(source, '|bucket-', substr(md5(text), 1, 2)) AS grp FROM documents"
_ASSIGNED = f"SELECT *, CASE WHEN {_U} < 0.1 THEN 'test' WHEN {_U} < 0.2 THEN 'val' ELSE 'train' END AS split FROM ({_SPLIT})"


def _assigned(spark, d) -> DataFrame:
    return C.splits(t(spark, d, "documents")).withColumn("source_type", C.source_type(F.col("source")))


@query("split_assign", f"SELECT doc_id, grp, split FROM ({_ASSIGNED})")
def split_assign(spark, d):
    return _assigned(spark, d).select("doc_id", F.col("group").alias("grp"), "split")


@query(
    "split_stats",
    f"SELECT split, source_type, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM ({_ASSIGNED}) GROUP BY GROUPING SETS ((split), (split, source_type))"
)
def split_stats(spark, d):
    x = _assigned(spark, d).groupingSets([["split"], ["split", "source_type"]], "split", "source_type")
    return x.agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes")
    )


@query(
    "manual_fraction",
    f"SELECT split, round(sum(len({_WORDS})) FILTER (source_type = 'manual') / sum(len({_WORDS})), 4) AS fraction, CAST(greatest(0, CAST(floor(0.2 * sum(len({_WORDS}))) AS BIGINT) - coalesce(sum(len({_WORDS})) FILTER (source_type = 'manual'), 0)) AS BIGINT) AS needed FROM ({_ASSIGNED}) GROUP BY split"
)
def manual_fraction(spark, d):
    x = _assigned(spark, d).select("split", "source_type", F.size(X.words(F.col("text"))).alias("n"))
    manual = F.sum(F.when(F.col("source_type") == "manual", F.col("n")))
    return x.groupBy("split").agg(
        F.round(manual / F.sum("n"), 4).alias("fraction"),
        F.greatest(F.lit(0), F.floor(F.sum("n") * 0.2) - F.coalesce(manual, F.lit(0))).cast("long").alias("needed")
    )


@query(
    "cap_downloaded",
    f"SELECT doc_id FROM (SELECT doc_id, {_TYPE} AS st FROM documents) QUALIFY st = 'manual' OR row_number() OVER (PARTITION BY st ORDER BY doc_id) <= 100"
)
def cap_downloaded(spark, d):
    docs = t(spark, d, "documents").select("doc_id", C.source_type(F.col("source")).alias("source_type"))
    return C.capped(docs, 100, ["doc_id"]).select("doc_id")


@query(
    "source_inventory",
    f"SELECT source, {_TYPE} AS source_type, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ALL"
)
def source_inventory(spark, d):
    x = t(spark, d, "documents").groupBy("source", C.source_type(F.col("source")).alias("source_type"))
    return x.agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes")
    )


#: Lower bounds of the length histogram's half-open buckets.
EDGES = (0, 200, 500, 1000, 2000, 5000, 10000, 50000)


@query(
    "length_histogram",
    "SELECT lo, count(*) AS docs FROM (SELECT CASE " + " ".join(
        f"WHEN length(text) >= {e} THEN {e}" for e in reversed(EDGES)
    ) + " END AS lo FROM documents) GROUP BY lo"
)
def length_histogram(spark, d):
    n = F.length("text")
    lo = F.coalesce(*(F.when(n >= e, e) for e in reversed(EDGES)))
    return t(spark, d, "documents").groupBy(lo.alias("lo")).agg(F.count(F.lit(1)).alias("docs"))


@query(
    "stage_funnel",
    f"""WITH m AS (SELECT text, {_REASON} AS reason FROM ({_MEASURED})), s AS (SELECT 1 AS i, 'raw' AS stage, count(*) AS n FROM m UNION ALL SELECT 2, 'clean', count(*) FILTER (reason IS NULL) FROM m UNION ALL SELECT 3, 'unique', count(DISTINCT md5(text)) FILTER (reason IS NULL) FROM m)
SELECT stage, n, round(n / lag(n) OVER (ORDER BY i), 4) AS retention FROM s""",
)
def stage_funnel(spark, d):
    m = t(spark, d, "documents").select(F.md5("text").alias("h"), X.reject_reason(F.col("text")).isNull().alias("ok"))
    g = m.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.first("ok").alias("ok"))
    s = g.agg(
        F.sum("c").alias("raw"), F.sum(F.when(F.col("ok"), F.col("c"))).alias("clean"),
        F.count(F.when(F.col("ok"), 1)).alias("unique")
    )
    long = s.select(
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(i).alias("i"), F.lit(k).alias("stage"), F.col(k).alias("n")) for i,
                    k in enumerate(("raw", "clean", "unique"))
                )
            )
        ).alias("x")
    ).select("x.*")
    return long.select("stage", "n", F.round(F.col("n") / F.lag("n").over(Window.orderBy("i")), 4).alias("retention"))


@query(
    "source_share_top",
    "WITH c AS (SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source), r AS (SELECT CASE WHEN row_number() OVER (ORDER BY chars DESC, source) <= 12 THEN source ELSE '(rest)' END AS source, chars FROM c) SELECT source, CAST(sum(chars) AS BIGINT) AS chars, round(sum(chars) / (SELECT sum(chars) FROM c), 6) AS share FROM r GROUP BY source",
)
def source_share_top(spark, d):
    counts = t(spark, d, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    return C.top_with_rest(counts, "source", "chars")


_TOKENS = f"SELECT doc_id, unnest({_WORDS}) AS token FROM documents"
_FREQ = f"SELECT token, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, token) AS rank FROM ({_TOKENS}) GROUP BY token"


def _tokens(spark, d) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.explode(X.words(F.col("text"))).alias("token"))


@query("token_frequency", f"SELECT token, c AS count, round(c / sum(c) OVER (), 9) AS share, rank FROM ({_FREQ})")
def token_frequency(spark, d):
    return K.token_frequency(_tokens(spark, d)).select(
        "token", "count", F.round("share", 9).alias("share"), F.col("rank").cast("long").alias("rank")
    )


@query("token_top50", f"SELECT token, c AS count FROM ({_FREQ}) WHERE rank <= 50")
def token_top50(spark, d):
    return _tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "token").limit(50)


@query(
    "token_coverage95",
    f"SELECT min(rank) AS n FROM (SELECT rank, sum(c) OVER (ORDER BY rank) AS run, sum(c) OVER () AS total FROM ({_FREQ})) WHERE run >= 0.95 * total"
)
def token_coverage95(spark, d):
    return K.covering(K.token_frequency(_tokens(spark, d)))


_PPL = f"WITH c AS (SELECT doc_id, token, count(*) AS c FROM ({_TOKENS}) GROUP BY ALL), n AS (SELECT doc_id, sum(c) AS n, sum(c * log2(c)) AS s FROM c GROUP BY doc_id) SELECT doc_id, round(CASE WHEN n <= 1 THEN 9999 ELSE pow(2, log2(n) - s / n) END, 4) AS ppl FROM n"


def _ppl(spark, d) -> DataFrame:
    return K.text_perplexity(t(spark, d, "documents")).select("doc_id", F.round("ppl", 4).alias("ppl"))


@query("pseudo_perplexity", _PPL)
def pseudo_perplexity(spark, d):
    return _ppl(spark, d)


@query(
    "perplexity_percentiles",
    f"WITH p AS MATERIALIZED (SELECT ppl, row_number() OVER (ORDER BY ppl) - 1 AS r, count(*) OVER () AS n FROM ({_PPL})) SELECT q AS p, ppl FROM p, (VALUES (0.10::DOUBLE), (0.25), (0.50), (0.75), (0.90), (0.95), (0.99)) v(q) WHERE r = CAST(floor(n * q) AS BIGINT)"
)
def perplexity_percentiles(spark, d):
    return K.index_percentiles(_cut(_ppl(spark, d)), "ppl", (0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99))


@query(
    "perplexity_retention",
    f"WITH p AS MATERIALIZED (SELECT x.ppl, y.words, row_number() OVER (ORDER BY ppl) - 1 AS r, count(*) OVER () AS n FROM ({_PPL}) x JOIN (SELECT doc_id, len({_WORDS}) AS words FROM documents) y USING (doc_id)), c AS (SELECT q, ppl AS cut FROM p, (VALUES (0.50::DOUBLE), (0.75), (0.80), (0.85), (0.90), (0.95), (0.98), (0.99)) v(q) WHERE r = least(CAST(floor(n * q) AS BIGINT), n - 1)) SELECT q AS p, CAST(count(*) FILTER (ppl <= cut) AS BIGINT) AS docs, CAST(sum(words) FILTER (ppl <= cut) AS BIGINT) AS words FROM p, c GROUP BY q",
)
def perplexity_retention(spark, d):
    scored = _cut(
        _ppl(spark, d).join(t(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).alias("w")), "doc_id")
    )
    cuts = K.index_percentiles(scored, "ppl", (0.50, 0.75, 0.80, 0.85, 0.90, 0.95, 0.98, 0.99)).withColumnRenamed("ppl", "cut")
    met = scored.join(F.broadcast(cuts), F.col("ppl") <= F.col("cut"))  # eight rows
    return met.groupBy("p").agg(F.count(F.lit(1)).alias("docs"), F.sum("w").alias("words"))


@query(
    "sequential_windows",
    f"SELECT doc_id, CAST(s AS INT) AS start, array_to_string(w[s+1:s+16], ' ') AS x, array_to_string(w[s+2:s+17], ' ') AS y FROM (SELECT doc_id, w, unnest(range(0, len(w) - 16, 16)) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 16)"
)
def sequential_windows(spark, d):
    rows = t(spark, d, "documents").select("doc_id", X.words(F.col("text")).alias("ids"))
    return K.windows(rows, 16).select("doc_id", "start", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


@query("prompt_windows")
def prompt_windows(spark, d):
    """Seeded windows cut into a prompt and its reference, the same for every run."""
    rows = t(spark, d, "documents").select("doc_id", X.words(F.col("text")).alias("ids"))
    return K.random_windows(rows, 48, 2, seed=3).select(
        "doc_id", "draw", "start", F.slice("x", 1, 16).alias("prompt"), F.slice("x", 17, 32).alias("reference")
    )


@query(
    "sft_mask",
    f"WITH r AS (SELECT conv_id, turn, list_transform({_WORDS}, lambda w: length(w)) AS w, greatest(1, len({_WORDS}) // 2) AS k FROM conversations) SELECT conv_id, turn, CAST(len(w) - 1 AS BIGINT) AS used, CAST(list_sum(w[k+1:len(w)]) AS BIGINT) AS target_sum FROM r WHERE len(w) BETWEEN 2 AND 64",
)
def sft_mask(spark, d):
    w = F.transform(X.words(F.col("text")), lambda x: F.length(x))
    rows = t(spark, d, "conversations").select("conv_id", "turn", w.alias("w")).filter("size(w) >= 2")
    k = F.greatest(F.lit(1), F.floor(F.size("w") / 2).cast("int"))
    rows = rows.select(
        "conv_id", "turn", F.slice("w", F.lit(1), k).alias("prompt"), F.slice("w", k + 1, F.size("w")).alias("target")
    )
    out = K.prompt_masked(rows, 64)
    counted = F.filter("labels", lambda x: x != -100)
    return out.select(
        "conv_id", "turn", (F.size("prompt") + F.size("target") - 1).cast("long").alias("used"),
        F.aggregate(counted, F.lit(0), lambda a, x: a + x).cast("long").alias("target_sum")
    )


@query(
    "diversity_distinct2",
    f"WITH g AS (SELECT unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) ELSE [] END) AS g FROM (SELECT {_WORDS} AS w FROM conversations)) SELECT round(count(DISTINCT g) / count(*), 9) AS value FROM g"
)
def diversity_distinct2(spark, d):
    return S.distinct_n(t(spark, d, "conversations"), 2).select(F.round("value", 9).alias("value"))


@query(
    "repetition_rate4",
    f"WITH g AS (SELECT CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) ELSE [] END AS g FROM (SELECT {_WORDS} AS w FROM documents)) SELECT round(avg(1 - len(list_distinct(g)) / len(g)), 9) AS value FROM g WHERE len(g) > 0"
)
def repetition_rate4(spark, d):
    return S.repetition(t(spark, d, "documents")).select(F.round("value", 9).alias("value"))


def _answer_pairs(spark, d) -> DataFrame:
    """User turns and the assistant turns that follow."""
    c = t(spark, d, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return c.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("hypothesis")
    ).join(a, ["conv_id", "turn"]).withColumn("id", F.concat_ws(":", "conv_id", "turn"))


@query("rouge_l")
def rouge_l(spark, d):
    return S.rouge_l(_answer_pairs(spark, d))


_CHAR_PAIRS = "SELECT u.conv_id, u.turn, regexp_replace(u.text, '[ \\t\\n\\r\\f\\x0b]+', '', 'g') AS h, regexp_replace(a.text, '[ \\t\\n\\r\\f\\x0b]+', '', 'g') AS r FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"


def _char_sql(n: int) -> str:
    g = lambda c: f"SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest(list_transform(range(1, length({c}) - {n} + 2), lambda i: substr({c}, i, {n}))) AS g FROM ({_CHAR_PAIRS})) GROUP BY ALL"
    return f"SELECT {n} AS n, CAST(coalesce(sum(least(coalesce(x.c, 0), coalesce(y.c, 0))), 0) AS BIGINT) AS matched, CAST(coalesce(sum(x.c), 0) AS BIGINT) AS hyp, CAST(coalesce(sum(y.c), 0) AS BIGINT) AS ref FROM ({g('h')}) x FULL JOIN ({g('r')}) y USING (conv_id, turn, g)"


@query("ngram_overlaps", " UNION ALL ".join(_char_sql(n) for n in (1, 2, 3, 4)))
def ngram_overlaps(spark, d):
    return S.overlaps(_answer_pairs(spark, d), (1, 2, 3, 4))


@query("bleu_char", f"""WITH o AS MATERIALIZED ({" UNION ALL ".join(_char_sql(n) for n in (1, 2, 3, 4))}), z AS (SELECT *, sum((matched = 0)::INT) OVER (ORDER BY n) AS z FROM o),
s AS (SELECT avg(ln(CASE WHEN matched = 0 THEN 1 / pow(2, z) / hyp ELSE matched / hyp END)) AS m, max(hyp) FILTER (n = 1) AS h, max(ref) FILTER (n = 1) AS r FROM z WHERE hyp > 0)
SELECT round(100 * CASE WHEN h >= r THEN 1 ELSE exp(1 - r / h) END * exp(m), 6) AS value FROM s""")  # fmt: skip
def bleu_char(spark, d):
    return S.bleu(_answer_pairs(spark, d)).select(F.round("value", 6).alias("value"))


_WORD_PAIRS = "SELECT u.conv_id, u.turn, {u} AS h, {a} AS r FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'".format(
    u=_WORDS.replace("(text,", "(u.text,"), a=_WORDS.replace("(text,", "(a.text,")
)


def _word_sql(n: int) -> str:
    g = lambda c: f"SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len({c}) - {n} + 2), lambda i: array_to_string({c}[i:i+{n - 1}], ' '))) AS g FROM ({_WORD_PAIRS})) GROUP BY ALL"
    return f"SELECT {n} AS n, CAST(coalesce(sum(least(coalesce(x.c, 0), coalesce(y.c, 0))), 0) AS BIGINT) AS matched, CAST(coalesce(sum(x.c), 0) AS BIGINT) AS hyp, CAST(coalesce(sum(y.c), 0) AS BIGINT) AS ref FROM ({g('h')}) x FULL JOIN ({g('r')}) y USING (conv_id, turn, g)"


@query("chrf", f"""WITH o AS ({" UNION ALL ".join([*(_char_sql(n) for n in range(1, 7)), *(_word_sql(n) for n in (1, 2))])}), p AS (SELECT matched / hyp AS p, matched / ref AS r FROM o WHERE hyp > 0 AND ref > 0)
SELECT round(100 * avg(CASE WHEN p = 0 THEN 0 ELSE 5 * p * r / (4 * p + r) END), 6) AS value FROM p""")  # fmt: skip
def chrf(spark, d):
    return S.chrf(_answer_pairs(spark, d)).select(F.round("value", 6).alias("value"))


@query("html_paragraphs", r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>', '', 'g'), '(?is)<!--.*?-->', '', 'g') AS h FROM pages),
p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(h, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g'))), lambda x: length(x) > 25 AND NOT contains(x, 'Copyright') AND NOT contains(x, 'All Rights Reserved')) AS ps FROM c)
SELECT page_id, CASE WHEN length(array_to_string(ps, chr(10) || chr(10))) >= 200 THEN md5(array_to_string(ps, chr(10) || chr(10))) END AS h FROM p""")  # fmt: skip
def html_paragraphs(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(W.paragraphs(F.col("html"))).alias("h"))


@query("html_links", r"""WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, unnest(regexp_extract_all(html, '(?i)href=["'']([^"''#\s]+)["'']', 1)) AS href FROM pages), f AS (SELECT page_id, base, regexp_replace(CASE WHEN starts_with(href, '/') THEN base || href ELSE href END, '[?#].*$', '') AS link FROM l)
SELECT DISTINCT page_id, link FROM f WHERE regexp_extract(link, '^(https?://[^/]+)', 1) = base AND length(link) - length(base) > 1 AND NOT regexp_matches(link, '(\.(png|jpg|jpeg|gif|svg|css|js|pdf|zip|mp4|mp3|xml|json)|/(tag|category|author|login|wp-admin))$')""")  # fmt: skip
def html_links(spark, d):
    return W.page_links(t(spark, d, "pages")).select("page_id", "link")


@query(
    "page_domains",
    "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS pages, round(median(length(html)), 4) AS middle FROM pages GROUP BY host"
)
def page_domains(spark, d):
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return t(spark, d, "pages").groupBy(host.alias("host")).agg(
        F.count(F.lit(1)).alias("pages"), F.round(F.percentile(F.length("html"), 0.5), 4).alias("middle")
    )


_PRED = f"SELECT quality, toxic, lang, CASE WHEN {_REASON} IS NULL THEN 1 ELSE 0 END AS predicted FROM (SELECT m.*, l.quality, l.toxic, d.lang FROM ({_MEASURED}) m JOIN labels l USING (doc_id) JOIN documents d USING (doc_id))"


def _predicted(spark, d) -> DataFrame:
    docs = t(spark, d, "documents").select(
        "doc_id", "lang", X.reject_reason(F.col("text")).isNull().cast("int").alias("predicted")
    )
    return docs.join(t(spark, d, "labels"), "doc_id")


@query(
    "sliced_accuracy",
    f"SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(toxic) = 0 THEN 'toxic' ELSE 'overall' END AS slice, coalesce(lang, CAST(toxic AS VARCHAR), 'all') AS level, count(*) AS n, CAST(sum(CASE WHEN quality = predicted THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(sum(CASE WHEN quality = predicted THEN 1 ELSE 0 END) / count(*), 4) AS accuracy FROM ({_PRED}) GROUP BY GROUPING SETS ((), (lang), (toxic))",
)
def sliced_accuracy(spark, d):
    return S.sliced_accuracy(_predicted(spark, d), ["lang", "toxic"], F.col("quality") == F.col("predicted"))


@query("confusion_matrix", f"SELECT quality, predicted, count(*) AS n FROM ({_PRED}) GROUP BY ALL")
def confusion_matrix(spark, d):
    return S.confusion(_predicted(spark, d), "quality", "predicted")


@query(
    "majority_baseline", "SELECT round(max(c) / sum(c), 9) AS baseline FROM (SELECT count(*) AS c FROM labels GROUP BY quality)"
)
def majority_baseline(spark, d):
    return S.majority(t(spark, d, "labels"), "quality").select(F.round("baseline", 9).alias("baseline"))


@query(
    "class_report",
    f"WITH c AS (SELECT quality, predicted, count(*) AS n FROM ({_PRED}) GROUP BY ALL), g AS (SELECT quality AS class, sum(n)::BIGINT AS support, sum(CASE WHEN quality = predicted THEN n ELSE 0 END) AS hit FROM c GROUP BY quality), p AS (SELECT predicted AS class, sum(n) AS named FROM c GROUP BY predicted), r AS (SELECT class, support, coalesce(hit / nullif(named, 0), 0) AS p, hit / support AS r FROM g LEFT JOIN p USING (class)) SELECT class, support, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM r",
)
def class_report(spark, d):
    return S.class_report(_predicted(spark, d), "quality", "predicted")


@query(
    "embedding_centroids",
    "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i AS dim, round(avg(x), 6) AS centre FROM e GROUP BY ALL"
)
def embedding_centroids(spark, d):
    x = t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return x.groupBy("label", (F.col("p") + 1).cast("long").alias("dim")).agg(
        F.round(F.avg(F.col("x").cast("double")), 6).alias("centre")
    )


@query("reasoning_items")
def reasoning_items(spark, d):
    return R.generated(spark, 900)


@query("reasoning_rules")
def reasoning_rules(spark, d):
    return R.rule_accuracy(R.generated(spark, 900))
