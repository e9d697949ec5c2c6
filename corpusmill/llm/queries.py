"""The queries of this folder, and SQL for those that SQL can express.

Where SQL can express a part of an operator's result only, a query of its own shows that part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .html_text import op5_html
from .jaccard import op9_jaccard
from .mixing import MOST_REPEATS, WEIGHTS, op8_mixing
from .ngram_lm import ORDER, PRIOR, op1_lm
from .packing import op3_packing
from .pii import op6_pii
from .quality import op7_quality
from .suffix_dedup import op4_suffix
from .syncmers import op10_fingerprints, whole_passages
from .vectors import op2_vectors


def lm_scores(spark, sf_dir) -> DataFrame:
    """op1_lm with its sums rounded, as they are added in another order in SQL."""
    sums = [F.round(c, 6).alias(c) for c in ("base_score", "score")]
    return op1_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", *sums)


def packing_totals(spark, sf_dir) -> DataFrame:
    """Of op3_packing: pieces lie gapless in their documents, and sequences are gapless and not too long."""
    pieces = op3_packing(spark, sf_dir)
    by_document = pieces.groupBy("doc_id").agg(
        F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens"), F.min("start").alias("first")
    )
    by_sequence = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")
    )
    documents = by_document.agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(F.expr("n <> tokens OR first <> 0"), 1)).alias("broken")
    )
    return documents.crossJoin(by_sequence.agg(F.count(F.when(F.expr("n <> `end` OR n > 1024"), 1)).alias("overfull")))  # one row each


def pii_base(spark, sf_dir) -> DataFrame:
    """The columns of op6_pii that the patterns alone give."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def quality_folds(spark, sf_dir) -> DataFrame:
    """Of op7_quality: how many rows of each fold have a score out of range, or a decision that is not the score's."""
    rows = op7_quality(spark, sf_dir)
    wrong = F.expr("score IS NULL OR NOT score BETWEEN 0 AND 1 OR predicted <> CAST(score >= 0.5 AS INT)")
    return rows.groupBy("held_out").agg(F.count(F.lit(1)).alias("docs"), F.count(F.when(wrong, 1)).alias("wrong"))


def mixing_targets(spark, sf_dir) -> DataFrame:
    """The columns of op8_mixing that are given, and whether a document is taken too often."""
    over = (F.col("taken") > MOST_REPEATS * F.col("size")).alias("over")
    return op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), over)


def mixing_totals(spark, sf_dir) -> DataFrame:
    """Of op8_mixing, by target: whether the words taken are near it."""
    sums = op8_mixing(spark, sf_dir).withColumn(
        "source", F.struct("source_size", "target")
    ).groupBy("source").agg(F.sum("taken").alias("taken"))
    return sums.select(
        F.round("source.target", 4).alias("target"),
        (F.abs(F.col("taken") - F.col("source.target")) <= 0.01 * F.col("source.target") + 256).alias("near")
    )


def fingerprint_texts(spark, sf_dir) -> DataFrame:
    """The columns of op10_fingerprints that describe the texts."""
    return op10_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def passage_places(spark, sf_dir) -> DataFrame:
    """Benchmark passages in documents, by anchors that agree on a place: the whole ones, with the first place in bytes."""
    return whole_passages(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm": op1_lm,
    "op2_vectors": op2_vectors,
    "op3_packing": op3_packing,
    "op4_suffix": op4_suffix,
    "op5_html": op5_html,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_jaccard": op9_jaccard,
    "op10_fingerprints": op10_fingerprints,
    "lm_scores": lm_scores,
    "packing_totals": packing_totals,
    "pii_base": pii_base,
    "quality_folds": quality_folds,
    "mixing_targets": mixing_targets,
    "mixing_totals": mixing_totals,
    "fingerprint_texts": fingerprint_texts,
    "passage_places": passage_places,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{_SPACE}'), lambda x: x <> '')"


#: The table of the reflected CRC-32 polynomial, and the sum of a number's digits.
_CRC = """crc_bits(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_bits WHERE k = 8),
crcs AS (SELECT doc_id, xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc FROM (SELECT DISTINCT doc_id FROM documents), crc_table)"""
#: Least doc_id or vec_id of all that links(a, b) reach, from ids(id).
_REACHED = """reach(a, b) AS (SELECT id, id FROM ids UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS id, min(b) AS least FROM reach GROUP BY a)"""


def _spans(kind: int, name: str, pattern: str, good: str) -> str:
    """Matches m of a pattern that pass a test, with their places: what stands before a match is what splitting leaves."""
    return f"""SELECT doc_id, {kind} AS kind, '{name}' AS name, m, start FROM (
  SELECT doc_id, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1),
    lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT)) AS start
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM documents
  WHERE text IS NOT NULL)) WHERE {good}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_DOUBLED = "CASE WHEN i % 2 = 0 THEN d[i] ELSE 2 * d[i] - CASE WHEN d[i] > 4 THEN 9 ELSE 0 END END"
_LUHN = f"list_sum(list_transform(range(1, len(d) + 1), lambda i: {_DOUBLED.replace('i % 2 = 0', '(len(d) - i) % 2 = 0')})) % 10 = 0"
_LUHN = _LUHN.replace("d[i]", f"substr({_DIGITS}, i, 1)::INT").replace("len(d)", f"length({_DIGITS})")
_BASE = " UNION ALL ".join([
    _spans(1, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _spans(2, "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: x::HUGEINT)) <= 255"),
    _spans(3, "card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    _spans(4, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
])

ORACLE: dict[str, str] = {
    "op2_vectors": f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x
  JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.98),
ids AS (SELECT vec_id AS id FROM embeddings), {_REACHED}
SELECT e.vec_id, coalesce(n, 0) AS n_links, least AS component_id, e.vec_id = least AS kept
FROM embeddings e JOIN component ON id = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = e.vec_id""",
    "op9_jaccard": f"""WITH RECURSIVE w AS (
  SELECT doc_id, {_words(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
m AS MATERIALIZED (SELECT * FROM u WHERE g IN (SELECT g FROM u GROUP BY g HAVING count(*) > 1)),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n AS n, count(*) AS shared
  FROM m x JOIN m y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) WHERE 100 * shared >= 85 * (n - shared)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
ids AS (SELECT doc_id AS id FROM documents), {_REACHED}
SELECT doc_id, len(s)::BIGINT AS n_shingles, least AS component_id FROM s JOIN component ON id = doc_id""",
    "lm_scores": f"""WITH RECURSIVE {_CRC},
w AS (SELECT doc_id, crc % 10 = 0 AS held_out, list_append({_words(f"translate(text, '{_UPPER}', '{_LOWER}')")}, chr(10)) AS w
  FROM documents JOIN crcs USING (doc_id)),
t AS (SELECT doc_id, held_out, unnest(w) AS token, unnest(list_prepend(chr(9), w[:-2])) AS past,
  unnest((list_prepend(NULL, list_prepend(chr(9), w[:-3])))[1:len(w)]) AS past2 FROM w),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
g AS (SELECT past, token, count(*) AS c FROM t WHERE NOT held_out GROUP BY ALL),
h AS (SELECT past, sum(c) AS c FROM g GROUP BY past),
g3 AS (SELECT past2, past, token, count(*) AS c FROM t WHERE NOT held_out AND past2 IS NOT NULL GROUP BY ALL),
h3 AS (SELECT past AS past2, token AS past, c FROM g),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c),
p1 AS (SELECT t.*, c.c AS known, n, (coalesce(c.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)) AS p FROM t LEFT
  JOIN c USING (token), n),
p2 AS (SELECT p1.*, (coalesce(g.c, 0) + {PRIOR} * p) / (coalesce(h.c, 0) + {PRIOR}) AS q FROM p1 LEFT JOIN g USING (past, token)
  LEFT JOIN h USING (past)),
p3 AS (SELECT p2.*, CASE WHEN past2 IS NULL THEN q ELSE (coalesce(g3.c, 0) + {PRIOR} * q) / (coalesce(h3.c, 0) + {PRIOR}) END AS r
  FROM p2 LEFT JOIN g3 USING (past2, past, token) LEFT JOIN h3 USING (past2, past))
SELECT doc_id, held_out, count(*) AS n_tokens, count(known) AS n_known, max(n) AS train_tokens,
  round(sum(log10(p)), 6) AS base_score, round(sum(log10({'r' if ORDER == 3 else 'q'})), 6) AS score FROM p3 GROUP BY doc_id, held_out""",
    "packing_totals": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS broken, 0::BIGINT AS overfull FROM documents",
    "op4_suffix": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n
  FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 99)) AS i, unnest(list_transform(range(0, n - 99), lambda i: md5(substr(h, 2 * i + 1, 200)))) AS w
  FROM d),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS past FROM s),
o AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * past + 1, 2 * (a - past)), ''
  ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)""",
    "pii_base": f"""WITH s AS ({_BASE}), n AS (SELECT doc_id, count(*) FILTER (kind = 1) AS n_email, count(*) FILTER (kind = 2) AS n_ip, count(*) FILTER (kind = 3) AS n_card, count(*) FILTER (kind = 4) AS n_phone,
  string_agg(name || ':' || start || ':' || (start + length(m)), ',' ORDER BY kind, start) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
  FROM documents LEFT JOIN n USING (doc_id)""",
    "quality_folds": f"WITH RECURSIVE {_CRC} SELECT crc % 3 = 1 AS held_out, count(*) AS docs, 0::BIGINT AS wrong FROM documents JOIN crcs USING (doc_id) GROUP BY ALL",
}

#: Targets by water-filling: sources in order of the level at which they are full, and the first level that holds.
_TARGETS = f"""d AS (SELECT doc_id, source, len({_words("text")})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source),
r AS (SELECT source, size, [{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w, sum(size) OVER ()::DOUBLE AS total
  FROM s),
o AS (SELECT *, {MOST_REPEATS} * size / w AS level, coalesce(sum({MOST_REPEATS} * size) OVER before, 0) AS full_, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_
  FROM r
  WINDOW before AS (ORDER BY {MOST_REPEATS} * size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - full_) / open_, level) AS unit FROM o WHERE (total - full_) / open_ <= level),
targets AS (SELECT source, size AS source_size, least({MOST_REPEATS} * size, w * coalesce(unit, 1e300)) AS target FROM r, l)"""
ORACLE |= {
    "passage_places": "SELECT item_id, doc_id, strlen(substr(d.text, 1, strpos(d.text, b.text) - 1))::BIGINT AS start FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "mixing_targets": f"WITH {_TARGETS} SELECT doc_id, size, source_size, round(target, 4) AS target, false AS over FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source",
    "mixing_totals": f"WITH {_TARGETS} SELECT round(target, 4) AS target, true AS near FROM targets",
    "fingerprint_texts": """SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(left(text, length(text) - length(text) // 2) || left(after, length(text) // 2)) AS edited_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), (SELECT coalesce(text, '')
  FROM documents ORDER BY doc_id DESC LIMIT 1)) AS after FROM documents)""",
}
