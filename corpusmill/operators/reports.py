"""Accounts of a corpus and of models: frontier, stages, shares, tokenizers, answers, runs and attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Characters to a token, where only an estimate is wanted.
CHARS_A_TOKEN = 3.15


def estimated_tokens(chars: Column) -> Column:
    return F.floor(chars / CHARS_A_TOKEN).cast("long")


def frontier_stats(frontier: DataFrame) -> DataFrame:
    """frontier(domain, status, n_chars) -> domain, status, urls, chars."""
    return frontier.groupBy("domain", "status").agg(
        F.count(F.lit(1)).alias("urls"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars")
    )


def pending_domains(frontier: DataFrame) -> DataFrame:
    return frontier.filter("status = 'pending'").select("domain").distinct()


def marked(frontier: DataFrame, results: DataFrame, most_attempts: int = 3) -> DataFrame:
    """frontier after results(url, outcome: ok, error or skip): done and skipped stay so, errors are pending again until
    `most_attempts`, then failed."""
    tries = F.col("attempts") + F.when(F.col("outcome").isNull(), 0).otherwise(1)
    status = (
        F.when(F.col("outcome") == "ok", "done").when(F.col("outcome") == "skip", "skipped")
        .when(F.col("outcome") == "error", F.when(tries >= most_attempts, "failed").otherwise("pending")).otherwise(F.col("status"))
    )
    return frontier.join(results, "url", "left").select("url", "domain", status.alias("status"), tries.alias("attempts"))


def retry_delay(attempt: Column, status: Column) -> Column:
    """Seconds before the next try, without jitter: 5 * 2^k when the server asks for patience, 2^k after an exception."""
    return F.when(
        (status == 429) | (status >= 500), 5 * F.pow(F.lit(2), attempt)
    ).when(status.isNull(), F.pow(F.lit(2), attempt)).cast("long")


def named_sources(domains: DataFrame, config: DataFrame) -> DataFrame:
    """domains(domain), config(domain, name, priority) -> domain, name (the domain itself by default), priority (9 by default)."""
    known = F.broadcast(config)  # a site list kept by hand
    return domains.join(known, "domain", "left").select(
        "domain", F.coalesce("name", "domain").alias("name"), F.coalesce("priority", F.lit(9)).alias("priority")
    )


def domain_verdict(probes: DataFrame, rate: float = 0.35, tokens: int = 100_000) -> DataFrame:
    """probes(domain, fetched, extracted, chars) -> domain, rate, est_tokens, verdict."""
    share = F.round(F.coalesce(F.try_divide("extracted", "fetched"), F.lit(0.0)), 4)
    out = probes.select("domain", share.alias("rate"), estimated_tokens(F.col("chars")).alias("est_tokens"))
    return out.withColumn("verdict", F.when((F.col("rate") >= rate) | (F.col("est_tokens") >= tokens), "seed").otherwise("skip"))


def stage_table(stages: list[tuple[str, DataFrame]], keys: tuple[str, ...] = ("lang", "kind")) -> DataFrame:
    """One row a key, one column a stage; a number that a stage did not report is said so."""
    out = None
    for name, df in stages:
        own = df.groupBy(*keys).agg(F.sum("docs").alias(name))
        out = own if out is None else out.join(own, list(keys), "full_outer")
    return out.select(*keys, *(F.coalesce(F.col(n).cast("string"), F.lit("not reported")).alias(n) for n, _ in stages))


def split_shares(rows: DataFrame, value: str) -> DataFrame:
    """rows(split, source_type, value) -> split (and `total`), value, share in percent, manual share in percent."""
    manual = F.sum(F.when(F.col("source_type") == "manual", F.col(value)).otherwise(0))
    sums = rows.groupingSets([["split"], []], "split").agg(F.sum(value).alias(value), manual.alias("manual"))
    whole = F.max(value).over(Window.partitionBy())  # four rows
    percent = lambda a, b: F.round(100 * a / b, 2)
    return sums.select(
        F.coalesce("split", F.lit("total")).alias("split"), value, percent(F.col(value), whole).alias("share"),
        percent(F.col("manual"), F.col(value)).alias("manual_share")
    )


def bucketed(scores: DataFrame, value: str, edges: tuple[float, ...]) -> DataFrame:
    """scores(value, words) -> lo, docs, words, est_tokens by half-open buckets."""
    lo = F.coalesce(*(F.when(F.col(value) >= e, F.lit(float(e))) for e in reversed(edges)))
    sums = scores.groupBy(lo.alias("lo")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("words").alias("words"), F.sum("chars").alias("chars")
    )
    return sums.select("lo", "docs", "words", estimated_tokens(F.col("chars")).alias("est_tokens"))


def text_tokens(encoded: DataFrame) -> DataFrame:
    """encoded(id, text, pieces) -> id, words, chars, tokens, per word, chars a token, joined pieces."""
    words, n = F.size(X.words(F.col("text"))), F.size("pieces")
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 2)
    return encoded.select(
        "id", words.cast("long").alias("words"), F.length("text").cast("long").alias("chars"), n.cast("long").alias("tokens"),
        ratio(n, words).alias("per_word"), ratio(F.length("text"), n).alias("chars_a_token"), F.array_join("pieces", " ").alias("joined"),
    )


def vocabulary_report(pieces: DataFrame, width: int, budget: int) -> DataFrame:
    """pieces(model, piece) -> model, size, share of single characters, embedding parameters and their share of a budget."""
    single = F.length(F.replace("piece", F.lit("▁"), F.lit(""))) == 1
    out = pieces.groupBy("model").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg(single.cast("int")), 4).alias("single"))
    cost = F.col("size") * width
    return out.select("model", "size", "single", cost.alias("embedding"), F.round(cost / budget, 6).alias("share"))


def preferred(models: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The model that comes first in an order of preference."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("model"))
    return models.filter(place > 0).agg(F.min_by("model", place).alias("model"))


def clean_answer(c: Column) -> Column:
    """The first word, without marks at its end."""
    return F.rtrim(F.coalesce(F.try_element_at(X.words(c), F.lit(1)), F.lit("")), F.lit("।,."))


def without_ending(c: Column, endings: tuple[str, ...]) -> Column:
    """Without the first of an ordered list of endings that it has; a word that is an ending only stays."""
    stem = F.regexp_extract(c, f"^(.+?)(?:{'|'.join(endings)})$", 1)
    return F.when(stem != "", stem).otherwise(c)


def answer_rates(rows: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    """rows(category, said, answer, candidates) -> category, n, strict, tolerant, named, invalid: shares of rows whose
    word is the answer, is it but for an ending, is any candidate but for an ending, is none."""
    word = clean_answer(F.col("said"))
    stem = without_ending(word, endings)
    rate = lambda test: F.round(F.avg(test.cast("int")), 4)
    named = F.array_contains("candidates", word) | F.array_contains("candidates", stem)
    tolerant = (word == F.col("answer")) | (stem == F.col("answer"))
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), rate(word == F.col("answer")).alias("strict"), rate(tolerant).alias("tolerant"),
        rate(named).alias("named"), rate(~named).alias("invalid")
    )


def wrong_examples(rows: DataFrame, most: int = 10) -> DataFrame:
    """The first wrong rows by item; a report's examples."""
    return rows.filter(
        clean_answer(F.col("said")) != F.col("answer")
    ).orderBy("item").limit(most).select("item", "said", "answer")


def rule_halves(rows: DataFrame, rules: list[str]) -> DataFrame:
    """rows(category, split, said, answer, a column a rule) -> category, rule, half, n, accuracy on the test rows: by
    whether the rule that is best on a category's training rows is right."""
    long = rows.unpivot(
        ["item", "category", "split", "said", "answer"], rules, "rule", "guess"
    ).withColumn("right", F.coalesce(F.col("guess") == F.col("answer"), F.lit(False)))
    rates = long.filter("split = 'train'").groupBy("category", "rule").agg(F.avg(F.col("right").cast("int")).alias("a"))
    best = rates.groupBy("category").agg(F.max_by("rule", F.struct("a", "rule")).alias("rule"))
    test = long.filter("split = 'test'").join(F.broadcast(best), ["category", "rule"])  # a row a category
    half = F.when(F.col("right"), "right").otherwise("wrong").alias("half")
    return test.groupBy("category", "rule", half).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("said") == F.col("answer")).cast("int")), 4).alias("accuracy")
    )


def skeleton(c: Column, names: list[str]) -> Column:
    """Names become <N>, with what is glued to them."""
    return F.regexp_replace(c, rf"(?U)\b(?:{'|'.join(names)})", "<N>")


def content_words(c: Column, stop: tuple[str, ...], least: int = 3) -> Column:
    """Different words that are long enough, no stop words, and not beside a number."""
    beside = F.array_union(
        F.regexp_extract_all(c, F.lit(r"\d\s*([^\d\s]+)"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"([^\d\s]+)\s*\d"), F.lit(1))
    )
    words = F.filter(X.words(c), lambda w: (F.length(w) >= least) & ~w.rlike(r"\d"))
    return F.array_except(F.array_except(words, F.array(*(F.lit(x) for x in stop))), beside)


def best_run(runs: DataFrame) -> DataFrame:
    """runs(lang, run, written, choice) -> lang, run: the greatest written score, then choice."""
    return runs.groupBy("lang").agg(F.max_by("run", F.struct("written", "choice", "run")).alias("run"))


def best_checkpoint(curve: DataFrame) -> DataFrame:
    """curve(run, step, loss, val_loss) -> run, step, val_loss where the validation loss is least; training rows have none."""
    known = curve.filter("val_loss IS NOT NULL").groupBy("run").agg(
        F.min_by("step", F.struct("val_loss", "step")).alias("step"), F.min("val_loss").alias("val_loss")
    )
    return known


def sweet_spot(settings: DataFrame) -> DataFrame:
    """settings(lang, setting, distance, chrf) -> with rank: nearest to the reference first, then by chrF."""
    by = Window.partitionBy("lang").orderBy("distance", F.desc("chrf"), "setting")
    return settings.select("lang", "setting", F.row_number().over(by).cast("long").alias("rank"))


def throughput(log: DataFrame, tokens_a_step: int) -> DataFrame:
    """log(run, step, seconds) -> run, step, tokens a second since the row before."""
    by = Window.partitionBy("run").orderBy("step")
    steps, time = F.col("step") - F.lag("step").over(by), F.col("seconds") - F.lag("seconds").over(by)
    return log.select("run", "step", F.round(F.try_divide(steps * tokens_a_step, time), 2).alias("rate"))


def merged_sweep(known: DataFrame, new: DataFrame) -> DataFrame:
    """known and new(size, val, accuracy) -> what is known and the sizes it lacks, with size as a number (5k: 5000)."""
    rows = known.unionByName(new.join(known.select("size"), "size", "left_anti"))
    return rows.select("size", (F.regexp_extract("size", r"^(\d+)k$", 1).cast("long") * 1000).alias("items"), "val", "accuracy")


def selectivity(weights: DataFrame) -> DataFrame:
    """weights(prompt, layer, head, role, p: last row's mass by token) -> layer, answer and distractor mass, ratio of means."""
    per = weights.groupBy("layer", "prompt", "head").agg(
        *(F.sum(F.when(F.col("role") == r, F.col("p"))).alias(r) for r in ("answer", "distractor"))
    )
    by = per.groupBy("layer", "prompt").agg(F.avg("answer").alias("answer"), F.avg("distractor").alias("distractor"))
    means = by.groupBy("layer").agg(F.avg("answer").alias("answer"), F.avg("distractor").alias("distractor"))
    return means.select(
        "layer", F.round("answer", 6).alias("answer"), F.round("distractor", 6).alias("distractor"),
        F.round(F.try_divide("answer", "distractor"), 6).alias("ratio")
    )


def attention_summary(heads: DataFrame) -> DataFrame:
    """heads(passage, layer, head, entropy) -> by layer and head, by layer, and over all: means over passages first."""
    per = heads.groupBy("layer", "head").agg(F.avg("entropy").alias("e"))
    return per.groupingSets([["layer", "head"], ["layer"], []], "layer", "head").agg(F.round(F.avg("e"), 6).alias("entropy"))


def usage(rows: DataFrame, column: str, most: int = 1) -> DataFrame:
    """How often each value is used, of those the most and the least used."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), column).limit(most).withColumn("end", F.lit("most"))
    return top.unionByName(counts.orderBy("n", column).limit(most).withColumn("end", F.lit("least")))


def favours(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """metrics(metric, lang, value) -> metric, favours (the language with the smaller value), gap."""
    wide = metrics.groupBy("metric").pivot("lang", [a, b]).agg(F.first("value"))
    return wide.select(
        "metric", F.when(F.col(a) < F.col(b), a).when(F.col(b) < F.col(a), b).otherwise("equal").alias("favours"),
        F.round(F.abs(F.col(a) - F.col(b)), 6).alias("gap")
    )


def run_settings(base: DataFrame) -> DataFrame:
    """base(vocab, train_tokens, tokens_a_step) -> vocab, max_steps, warm-up (1.8 %, in tens)."""
    steps = F.floor(F.col("train_tokens") / F.col("tokens_a_step")).cast("long")
    return base.select("vocab", steps.alias("max_steps"), (F.round(steps * 0.018 / 10) * 10).cast("long").alias("warmup"))


def consistent(models: DataFrame, tokenizers: DataFrame) -> DataFrame:
    """models(model, vocab), tokenizers(model, size): fails when it is run if a model's vocabulary is not its tokenizer's."""
    wrong = F.concat(F.lit("vocabulary of "), "model", F.lit(" is not its tokenizer's"))
    both = models.join(tokenizers, "model", "left")
    return both.select(
        "model",
        F.when(
            F.col("vocab").eqNullSafe(F.col("size")), F.col("vocab")
        ).otherwise(F.raise_error(wrong).cast("long")).alias("vocab")
    )


def replayed(tasks: DataFrame, corpus: DataFrame, every: int, seed: int = 0) -> DataFrame:
    """tasks(id) and corpus(id) in one order by hash, `every` task rows to one of the corpus: kind, id, step.

    Rows keep a place by their own rank, so the mix is the same in every run; corpus rows that have no step are left.
    """
    from .tokens import numbered

    turn = lambda df: numbered(df.select("id"), [F.xxhash64(F.lit(seed), "id"), "id"], "r")[0]
    a = turn(tasks).select(F.lit("task").alias("kind"), "id", F.floor((F.col("r") - 1) / every).alias("step"))
    b = turn(corpus).select(F.lit("replay").alias("kind"), "id", (F.col("r") - 1).alias("step"))
    return a.unionByName(b.join(a.select("step").distinct(), "step", "left_semi").select("kind", "id", "step"))
