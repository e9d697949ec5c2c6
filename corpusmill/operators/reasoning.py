"""Synthetic comparison and ordering questions, rules that answer them without reading, and the audit of such shortcuts.

Every pick is a hash of (seed, item, slot), so items are the same in every run and on any number of executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = "Asha Bina Chand Dev Esha Gita Hari Indra Jaya Kiran Lata Mohan Nita Om Priya Ravi Sita Tara Uma Vijay Yash Zoya".split()
ATTRIBUTES = {
    "age": ("older", "younger", "oldest", "youngest"), "height": ("taller", "shorter", "tallest", "shortest"),
    "speed": ("faster", "slower", "fastest", "slowest")
}
EQUAL = "equal"
CATEGORIES = (
    "direct", "numeric", "three", "mixed", "chain_superlative", "chain_relation", "ranking", "price", "chain3_superlative"
)
RULES = ("first_named", "last_named", "question_first", "question_second", "most_first", "most_last", "always_equal")


def pick(slot: str, n: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "item", F.lit(slot)), F.lit(n)).cast("int")


def shuffled(values: Column, slot: str, seed: int = 0) -> Column:
    """An array in an order by hash of item, slot and element."""
    keyed = F.transform(values, lambda v: F.struct(F.xxhash64(F.lit(seed), "item", F.lit(slot), v).alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def generated(
    spark: SparkSession, n: int, seed: int = 0, names: list[str] | None = None, numbers: tuple[int, int] = (5, 40)
) -> DataFrame:
    """item, category, text, candidates, answer, answer_position, hops; categories by turns, names and order by hash."""
    names, (low, high) = names or NAMES, numbers
    pool = F.array(*(F.lit(x) for x in names))
    base = spark.range(n).withColumnRenamed("id", "item")
    base = base.withColumn(
        "category", F.element_at(F.array(*(F.lit(c) for c in CATEGORIES)), (F.col("item") % len(CATEGORIES) + 1).cast("int"))
    )
    base = base.withColumn("people", F.slice(shuffled(pool, "names", seed), 1, 4))  # from most to least
    words = F.array(*(F.array(*(F.lit(w) for w in a)) for a in ATTRIBUTES.values()))
    base = base.withColumn(
        "w", F.element_at(words, pick("attribute", len(ATTRIBUTES), seed) + 1)
    ).withColumn("most", pick("most", 2, seed) == 0)
    value = F.lit(low) + pick("number", high - low, seed)
    p = lambda i: F.element_at("people", i)
    more, less, top, bottom = (F.element_at("w", i) for i in (1, 2, 3, 4))
    fact = lambda a, b, slot: F.when(
        pick(slot, 2, seed) == 0, F.concat_ws(" ", a, F.lit("is"), more, F.lit("than"), b)
    ).otherwise(F.concat_ws(" ", b, F.lit("is"), less, F.lit("than"), a))
    superlative = F.concat(F.lit(" Who is the "), F.when(F.col("most"), top).otherwise(bottom), F.lit("?"))
    amount = lambda a, x: F.concat(a, F.lit(" has "), x.cast("string"), F.lit(" points"))
    two, three, four = (F.slice("people", 1, k) for k in (2, 3, 4))
    said = lambda facts, slot: F.concat(F.array_join(shuffled(F.array(*facts), slot, seed), ". "), F.lit("."))
    link = [fact(p(i), p(i + 1), f"link{i}") for i in (1, 2, 3)]
    tie = pick("tie", 3, seed) == 0
    relation = lambda a, b: F.concat(
        F.lit(" Who is "), F.when(F.col("most"), more).otherwise(less), F.lit(", "),
        F.array_join(shuffled(F.array(a, b), "asked", seed), " or "), F.lit("?")
    )
    of = lambda a, b: F.when(F.col("most"), a).otherwise(b)
    price = lambda unit: said(
        [
            F.concat(p(1), F.lit(f" {unit} "), (value + 1 + pick("gap", 9, seed)).cast("string")),
            F.concat(p(2), F.lit(f" {unit} "), value.cast("string"))
        ],
        "facts"
    )
    forms = {
        "direct": (F.concat(link[0], F.lit("."), superlative), two, of(p(1), p(2)), 1),
        "numeric": (F.concat(said([amount(p(1), value + 1 + pick("gap", 9, seed)), amount(p(2), value)], "facts"), F.lit(" Who has "), of(F.lit("more"), F.lit("less")), F.lit("?")), two, of(p(1), p(2)), 1),
        "price": (F.concat(price("costs"), F.lit(" Which costs "), of(F.lit("more"), F.lit("less")), F.lit("?")), two, of(p(1), p(2)), 1),
        "three": (F.concat(said(link[:2], "facts"), superlative), three, of(p(1), p(3)), 2),
        "mixed": (F.concat(F.when(tie, F.concat_ws(" ", p(1), F.lit("and"), p(2), F.lit("are the same"))).otherwise(link[0]), F.lit("."), relation(p(1), p(2))), F.concat(two, F.array(F.lit(EQUAL))), F.when(tie, F.lit(EQUAL)).otherwise(of(p(1), p(2))), 1),
        "chain_superlative": (F.concat(said(link[:2], "facts"), superlative), three, of(p(1), p(3)), 2),
        "chain_relation": (F.concat(said(link[:2], "facts"), relation(p(1), p(3))), F.array(p(1), p(3)), of(p(1), p(3)), 2),
        "chain3_superlative": (F.concat(said(link, "facts"), superlative), four, of(p(1), p(4)), 3),
        "ranking": (F.concat(said(link[:2], "facts"), F.lit(" Who is in the middle?")), three, p(2), 2),
    }

    def by_category(i: int) -> Column:
        value_of = lambda f: f[i] if isinstance(f[i], Column) else F.lit(f[i])
        return reduce(
            lambda a, kv: a.when(F.col("category") == kv[0], value_of(kv[1])), list(forms.items())[1:],
            F.when(F.col("category") == "direct", value_of(forms["direct"]))
        )

    out = base.select(
        "item", "category", by_category(0).alias("text"), shuffled(by_category(1), "candidates", seed).alias("candidates"),
        by_category(2).alias("answer"), by_category(3).alias("hops")
    )
    return out.withColumn("answer_position", (F.array_position("candidates", F.col("answer")) - 1).cast("int"))


def named_in(text: Column, candidates: Column) -> Column:
    """Candidates by their first place in a text."""
    found = F.filter(
        F.transform(candidates, lambda c: F.struct(F.instr(text, c).alias("at"), c.alias("name"))), lambda x: x["at"] > 0
    )
    return F.transform(F.array_sort(found), lambda x: x["name"])


def rule_answers(items: DataFrame) -> DataFrame:
    """items with one column a rule: the answer it would give without reading."""
    asked = F.substring_index("text", ". ", -1)
    items = items.withColumn(
        "_q", F.col("text").substr(F.length("text") - F.length(asked) + 1, F.length(asked))
    ).withColumn("_f", F.expr("left(text, length(text) - length(substring_index(text, '. ', -1)))"))
    own = F.filter("candidates", lambda c: c != EQUAL)
    items = items.withColumn("_n", named_in(F.col("_f"), own)).withColumn("_a", named_in(F.col("_q"), own))
    has = lambda i: reduce(
        lambda a, b: a | b,
        [
            F.col("_q").contains(w[j]) for w in ATTRIBUTES.values() for j in i
        ] + [F.col("_q").contains("more" if 0 in i else "less")]
    )
    most, least = has((0, 2)), has((1, 3))
    first, last = F.try_element_at("_n", F.lit(1)), F.try_element_at("_n", F.lit(-1))
    up, down = most & ~least, least & ~most
    return items.select(
        *(c for c in items.columns if c[0] != "_"), first.alias("first_named"), last.alias("last_named"), F.try_element_at("_a", F.lit(1)).alias("question_first"), F.try_element_at("_a", F.lit(2)).alias("question_second"),
        F.when(up, first).when(down, last).alias("most_first"), F.when(up, last).when(down, first).alias("most_last"), F.when(F.array_contains("candidates", EQUAL), EQUAL).alias("always_equal"),
    )


def rule_accuracy(items: DataFrame) -> DataFrame:
    """category, n, chance, and how often each rule is right."""
    r = rule_answers(items)
    right = [F.round(F.avg(F.coalesce(F.col(x) == F.col("answer"), F.lit(False)).cast("int")), 3).alias(x) for x in RULES]
    return r.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(1 / F.size("candidates")), 3).alias("chance"), *right
    )


def renamed(items: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Names exchanged everywhere: in the text word by word (marks at the end stay), in candidates and answer."""
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    one = lambda w: F.coalesce(
        F.try_element_at(table, F.regexp_replace(w, r"[.,?!]+$", "")) , F.regexp_replace(w, r"[.,?!]+$", "")
    )
    text = F.array_join(F.transform(F.split("text", " "), lambda w: F.concat(one(w), F.regexp_extract(w, r"([.,?!]*)$", 1))), " ")
    return items.withColumn("text", text).withColumn(
        "candidates", F.transform("candidates", one)
    ).withColumn("answer", one(F.col("answer")))


def reversed_facts(text: Column) -> Column:
    """The same facts from last to first, the question where it was."""
    parts = F.split(text, r"\. ")
    n = F.size(parts)
    return F.array_join(
        F.concat(F.reverse(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0)))), F.slice(parts, n, F.lit(1))), ". "
    )


def swapped(text: Column, a: Column, b: Column) -> Column:
    """Two names exchanged, where each stands exactly once; null elsewhere."""
    once = lambda x: F.length(text) - F.length(F.replace(text, x, F.lit(""))) == F.length(x)
    return F.when(once(a) & once(b), F.replace(F.replace(F.replace(text, a, F.lit("\x00")), b, a), F.lit("\x00"), b))


def probe_summary(pairs: DataFrame) -> DataFrame:
    """pairs(answer, original, edited, edited_answer) -> n, accuracy before and after an edit, and how often both agree."""
    rate = lambda c: F.round(F.avg(c.cast("int")), 4)
    ok, ok2 = F.col("original") == F.col("answer"), F.col("edited") == F.col("edited_answer")
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), rate(ok).alias("original"), rate(ok2).alias("edited"), rate(ok == ok2).alias("consistent")
    )


def with_quotas(items: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """The first items of each category up to its quota, of equal texts the first."""
    different = items.groupBy("category", "text").agg(F.min("item").alias("item"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy("item"))
    most = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col("category")]
    chosen = different.withColumn("_r", rank).filter(F.col("_r") <= most).select("item")
    return items.join(chosen, "item", "left_semi")


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a without rows whose key stands in b."""
    return a.join(b.select(key), key, "left_anti")
