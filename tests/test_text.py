"""Normalisation, measures and reasons on literal rows."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.python_udfs import blake2b_64, lcs_length, nfc

GOOD = "राम और श्याम आज बाजार गए। वहाँ उन्होंने ताजे फल खरीदे। सेब बहुत मीठे थे। केले पके हुए मिले। दुकानदार ने मुस्कुराकर धन्यवाद कहा। फिर दोनों मित्र नदी के किनारे बैठे। पानी शांत था। हवा ठंडी चल रही थी। पक्षी पेड़ों पर गा रहे थे। शाम को वे घर लौट आए।"


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    ("column", "given", "want"),
    [
        (X.remove_invisible, "a\u200bb\u00adc\u200d", "abc"),
        (X.blank_controls, "a\x07b\tc\nd\re", "a b\tc\nd\re"),
        (X.ascii_digits, "१२३", "123"),
        (X.repair_danda, "क | ख || ग ।।। घ", "क । ख ॥ ग । घ"),
        (X.collapse_space, "a \t  b \n\n\n\n c", "a b\n\nc"),
        (X.strip, "  a ", "a"),
        (X.drop_foreign_sentences, "पानी है। this is english. ठीक है?\nसब ठीक।", "पानी है।\nसब ठीक।"),
        (X.remove_images, "a ![x](y.png) b http://h/z.pdf c", "a   b   c"),
        (nfc, "e\u0301", "\u00e9"),
    ],
)
def test_steps(spark, column, given, want):
    assert one(spark, column, given) == want


def test_normalised_twice_is_the_same(spark):
    once = one(spark, X.normalised, "राम   १२ | क\n\n\n\nhello. ठीक।")
    assert one(spark, X.normalised, once) == once


@pytest.mark.parametrize(("given", "want"), [("पानी", 1.0), ("हिंदी hindi", 0.5), ("123", 0.0), ("", 0.0)])
def test_script_ratio(spark, given, want):
    assert one(spark, lambda c: X.script_ratio(c, X.DEVANAGARI), given) == want


def test_reasons_in_order(spark):
    reason = lambda t: one(spark, lambda c: X.reject_reason(c, script=X.DEVANAGARI), t)
    assert reason(GOOD) is None
    assert reason("छोटा।") == "too_short"
    assert reason("This is English text. " * 10) == "low_script_ratio"
    assert reason("JFIF" + GOOD) == "image_or_binary_file"
    assert reason((GOOD[:60] + "।\n") * 50) == "duplicate_lines"
    assert reason("राम घर गया। " * 40) == "duplicate_ngrams"
    assert reason("क" * 30 + " " + "ख" * 200 + "।") == "bad_word_length"
    assert reason(GOOD.replace("।", "")) == "no_sentence_terminals"
    assert reason(GOOD + " #" * 30 + "।") == "symbol_heavy"


def test_short_and_empty_ngrams_and_shingles(spark):
    assert one(spark, lambda c: X.ngrams(X.words(c), 5), "a b c d") == []
    assert one(spark, lambda c: X.ngrams(X.words(c), 2), "a b c") == ["a b", "b c"]
    assert one(spark, X.shingles, "") == [""]
    assert one(spark, X.shingles, "abc") == ["abc"]
    assert one(spark, X.shingles, "abcdefgh") == ["abcde", "cdefg"]
    assert one(spark, lambda c: X.repeated_line_fraction(X.lines(c)), "x\nx\nx\nx") == 0.75


def test_group_keys(spark):
    df = spark.createDataFrame([("s", "https://x/2023/5/a", "ab12"), ("s", "https://x/2023-11-2", "ab12"), ("s", "https://x/y", "ab12"), ("s", None, "ab12")], "source string, url string, id string")
    got = [r[0] for r in df.select(X.group_key(F.col("source"), F.col("url"), F.col("id"))).collect()]
    assert got == ["s|2023-05", "s|2023-11", "s|bucket-ab", "s|bucket-ab"]


def test_python_functions(spark):
    assert lcs_length(list("abcbdab"), list("bdcaba")) == 4
    assert one(spark, blake2b_64, "abc") == "d8bb14d833d59559"
