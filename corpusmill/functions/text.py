"""Column functions on text: normalisation steps, measures, quality reasons. All of them are Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters, extensions and headers that results must agree on.
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
DIGITS = ("०१२३४५६७८९", "0123456789")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "svg", "pdf")
BINARY_URL_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".pdf", ".ico", ".bmp", ".tif", ".tiff")
BINARY_HEADERS = ("JFIF", "Exif", "Photoshop", "XMP", "%PDF", "\x00\x00")
SYMBOLS = "#…•|©®™"
#: White space of Unicode, as a class that Java and RE2 read alike, without its brackets; and its characters.
WHITE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WHITE_CHARS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
TERMINALS = "।॥?!"


@dataclass(frozen=True)
class Script:
    """A script profile: character classes for letters of the script, all letters, and sentence terminals."""

    own: str
    letters: str
    terminals: str


DEVANAGARI = Script(r"[ऀ-ॿ&&[\p{L}\p{Mn}\p{Mc}]]", r"[\p{L}\p{Mn}\p{Mc}]", TERMINALS)
LATIN = Script(r"[\p{IsLatin}&&[\p{L}\p{Mn}\p{Mc}]]", r"[\p{L}\p{Mn}\p{Mc}]", ".?!")


@dataclass(frozen=True)
class Thresholds:
    min_chars: int = 200
    min_script_ratio: float = 0.75
    min_word_len: float = 1.5
    max_word_len: float = 12.0
    min_terminal_frac: float = 0.20
    max_symbol_ratio: float = 0.10
    max_dup_lines: float = 0.30
    max_dup_ngrams: float = 0.20
    ngram: int = 5


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(_WHITE_CHARS))


def remove_invisible(c: Column) -> Column:
    return F.translate(c, INVISIBLE, "")


def invisible_count(c: Column) -> Column:
    return F.length(c) - F.length(remove_invisible(c))


def remove_images(c: Column) -> Column:
    """Markdown images, img tags, and URLs or names of image files become a space."""
    kinds = "|".join(IMAGE_EXTENSIONS)
    return F.regexp_replace(c, rf"(?i)!\[.*?\]\(.*?\)|<img[^>]*>|https?://\S+\.(?:{kinds})|\b\S+\.(?:{kinds})\b", " ")


def blank_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ")


def ascii_digits(c: Column) -> Column:
    return F.translate(c, *DIGITS)


def repair_danda(c: Column) -> Column:
    """Pipes typed for dandas, then repeated dandas."""
    c = F.regexp_replace(c, r"\|\|", "॥")
    c = F.regexp_replace(c, r"(?U)(?<=[ऀ-ॿ\s])\|", "।")
    return collapse_danda(c)


def collapse_danda(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "।{2,}", "।"), "॥{2,}", "॥")


def collapse_space(c: Column) -> Column:
    c = F.regexp_replace(c, r"[ \t\u00a0]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def sentences(c: Column, terminals: str = TERMINALS) -> Column:
    """Pieces after which a terminal stands, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, f"(?<=[{terminals}])"), strip), lambda s: s != "")


def drop_foreign_sentences(c: Column, foreign: str = "[a-zA-Z]", terminals: str = TERMINALS) -> Column:
    """By line, the sentences without foreign letters; blank lines stay blank. Texts without any stay as they are."""

    def line(p: Column) -> Column:
        kept = F.filter(F.transform(F.split(p, rf"(?<=[{terminals}])(?U)\s*"), strip), lambda s: (s != "") & ~s.rlike(foreign))
        return F.array_join(kept, " ")

    return F.when(c.rlike(foreign), F.array_join(F.transform(F.split(c, "\n"), line), "\n")).otherwise(c)


def normalised(c: Column, digits: bool = True, nfc: bool = False) -> Column:
    """All steps in order. nfc adds canonical composition, which needs Python (Arrow batches)."""
    from .python_udfs import nfc as compose

    c = compose(c) if nfc else c
    c = blank_controls(remove_invisible(drop_foreign_sentences(remove_images(c))))
    c = ascii_digits(c) if digits else c
    return strip(collapse_space(repair_danda(c)))


def normalised_plain(c: Column) -> Column:
    """The steps that hold for any script: invisible and control characters, white space, ends."""
    return strip(collapse_space(blank_controls(remove_invisible(c))))


def _parts(c: Column, separator: str) -> Column:
    """Pieces of a stripped text; none of an empty one."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, separator))


def words(c: Column) -> Column:
    """Runs of characters other than Unicode white space."""
    return _parts(strip(c), f"[{WHITE}]+")


def lines(c: Column) -> Column:
    """Stripped lines that are not empty. No run of white space is tried from its middle."""
    blank = f"[{WHITE}&&[^\\n]]"
    return _parts(strip(c), f"(?<!{blank}){blank}*+\\n[{WHITE}]*+")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once a row: inside a lambda, an expression would be worked out for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(tokens: Column, n: int, of: Callable[[Column], Column], kind: str) -> Column:
    """of(n tokens in a row) for every place; an empty array for shorter texts."""

    def every(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
        return F.when(
            F.size(w) >= n, F.transform(starts, lambda i: of(F.slice(w, i, F.lit(n))))
        ).otherwise(F.array().cast(f"array<{kind}>"))

    return let(tokens, every)


def ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams, each joined by a space; none for shorter texts."""
    return _runs(tokens, n, lambda x: F.array_join(x, " "), "string")


def hashed_ngrams(tokens: Column, n: int) -> Column:
    """64-bit hashes of word n-grams, where only equality counts."""
    return _runs(tokens, n, F.xxhash64, "bigint")


def shingles(c: Column, k: int = 5, stride: int = 2) -> Column:
    """Distinct k-character shingles at every second place; short texts give themselves, an empty one the empty string."""

    def of(chars: Column) -> Column:
        last = F.greatest(F.size(chars) - k, F.lit(0))
        return F.array_distinct(
            F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: F.array_join(F.slice(chars, i + 1, F.lit(k)), ""))
        )

    return let(F.filter(F.split(c, ""), lambda x: x != ""), of)


def repeated_fraction(items: Column) -> Column:
    """Share of items beyond the first of their kind."""
    return let(items, lambda x: F.when(F.size(x) > 0, 1 - F.size(F.array_distinct(x)) / F.size(x)).otherwise(F.lit(0.0)))


def _count(c: Column, chars: str) -> Column:
    """How many characters of a class there are: whole runs are cut out, and the length is compared."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{chars}+", ""))


def script_ratio(c: Column, script: Script = LATIN) -> Column:
    return F.coalesce(F.try_divide(_count(c, script.own), _count(c, script.letters)), F.lit(0.0))


def terminal_fraction(c: Column, own: Column, script: Script = LATIN) -> Column:
    """Share of lines, of those given, whose last character is a terminal."""
    ends = F.regexp_count(c, F.lit(f"[{re.escape(script.terminals)}][{WHITE}&&[^\\n]]*+(?:\\n|\\z)"))
    return F.coalesce(F.try_divide(ends, F.size(own)), F.lit(0.0))


def repeated_line_fraction(own: Column) -> Column:
    return F.when(F.size(own) < 2, F.lit(0.0)).otherwise(repeated_fraction(own))


def measured(c: Column, t: Thresholds = Thresholds(), script: Script = LATIN) -> Column:
    """words, word_len (characters outside white space to a word), terminal (share of lines that end with one), symbols (to
    a word), dup_lines, dup_grams (shares beyond the first of their kind): worked out in Arrow batches, once a row."""
    from .python_udfs import text_measures

    return text_measures(script.terminals, SYMBOLS, t.ngram)(c)


def is_binary(c: Column, url: Column | None = None) -> Column:
    """The URL ends like a picture or document file, or the text begins with a header of one."""
    head = F.substring(c, 1, 300)
    found = reduce(lambda a, b: a | b, (head.contains(h) for h in BINARY_HEADERS))
    if url is not None:
        path = F.lower(F.substring_index(F.coalesce(url, F.lit("")), "?", 1))
        found = found | reduce(lambda a, b: a | b, (path.endswith(x) for x in BINARY_URL_EXTENSIONS))
    return found


def reject_reason(c: Column, t: Thresholds = Thresholds(), script: Script = LATIN, url: Column | None = None) -> Column:
    """The first reason, in a fixed order, for which a text is rejected; null if it is kept."""

    early = (
        F.when(is_binary(c, url), "image_or_binary_file")
        .when(F.length(c) < t.min_chars, "too_short")
        .when(script_ratio(c, script) < t.min_script_ratio, "low_script_ratio")
    )
    m = measured(F.when(early.isNull(), c), t, script)
    return F.coalesce(
        early,
        F.when((m["word_len"] < t.min_word_len) | (m["word_len"] > t.max_word_len), "bad_word_length")
        .when(m["terminal"] < t.min_terminal_frac, "no_sentence_terminals")
        .when(m["symbols"] > t.max_symbol_ratio, "symbol_heavy")
        .when(m["dup_lines"] > t.max_dup_lines, "duplicate_lines")
        .when(m["dup_grams"] > t.max_dup_ngrams, "duplicate_ngrams")
    )


def iso_seconds(time: Column) -> Column:
    """A time as ISO 8601 in UTC, to the second."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def unit_hash(c: Column) -> Column:
    """A string's place in [0, 1) by 60 bits of its md5."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("double") / F.lit(float(2**60))


def group_key(source: Column, url: Column, content_id: Column) -> Column:
    """source|YYYY-MM from a date in the URL's path, else source|bucket-XX by content."""
    year, month = (F.regexp_extract(url, r"/(20\d{2})[/-](\d{1,2})[/-]", i) for i in (1, 2))
    dated = F.concat(source, F.lit("|"), year, F.lit("-"), F.lpad(month, 2, "0"))
    return F.when(F.coalesce(year, F.lit("")) != "", dated).otherwise(
        F.concat(source, F.lit("|bucket-"), F.substring(content_id, 1, 2))
    )


def split_of(key: Column, val: float = 0.1, test: float = 0.1, salt: str = "lma") -> Column:
    """train, val or test, the same for all documents of a group."""
    u = unit_hash(F.concat(F.lit(salt + "|"), key))
    return F.when(u < test, "test").when(u < test + val, "val").otherwise("train")


def run_lengths(items: Column) -> Column:
    """How often each different item stands in an array, in the order of the items."""

    def of(x: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(x))
        starts = F.filter(
            places, lambda i: (i == 1) | (F.try_element_at(x, i) != F.try_element_at(x, F.greatest(i - 1, F.lit(1))))
        )
        ends = lambda s: F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(x) + 1))
        return let(starts, lambda s: F.zip_with(s, ends(s), lambda a, b: b - a))

    return let(F.array_sort(items), lambda x: F.when(F.size(x) > 0, of(x)).otherwise(F.array().cast("array<int>")))
