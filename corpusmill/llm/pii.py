"""Personal data by a skip-chain conditional random field over the mentions of a document.

Base spans come from fixed patterns (e-mail addresses, IP addresses, payment cards, telephone numbers). The mentions of
a document are its base spans, whose labels are given, and what looks like such data but does not fit a pattern: long
groups of digits, and addresses with a spelled-out at sign. A mention has a potential for each label from its features;
neighbouring mentions share a chain potential; mentions with a similar key (same last digits, same local part), however
far apart, are joined by skip edges to one hub for their key, whose potential favours equal labels. Where base spans are
among them, the hub has a label of theirs, whatever the others look like. Loopy message passing, until nothing changes,
gives each mention's marginals, so that a number that is written as a telephone number once speaks for all its repeats
in that document alike, however far away; besides that only their own features and neighbours count. Mentions whose most likely label is a kind of personal data, with probability `least` at least, are added to the base spans.

The weights are fitted in each run on at most `sample` documents of at most `sample_chars` characters that hold digits
or an at sign, chosen by hash: base spans are the labels; chain potentials are smoothed log ratios of label pairs met in
them. Skip potentials are fixed: what fits no pattern has no labels to learn them from. Detection covers every whole text.

Defined results: null and empty texts have no spans. Overlapping spans of different kinds are all kept; an added
span never overlaps a base one. Repeated rows each get a row. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base spans. Look-behinds only keep long runs from being tried at each place.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = re.compile(r"\(?[0-9][0-9().\x20-]{5,}[0-9]")
_SPELLED = re.compile(r"\s?(?:\(at\)|\[at\]|\{at\})\s?", re.I)
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[A-Za-z0-9-]++)+", re.I)
_ANY = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.I)
_NO_DIGIT = re.compile(r"[^0-9]+")
#: How much less likely (in logs) personal data is in what fits no pattern, before its like speak for it.
DOUBT = 4.0
NEVER = -1e9
FEATURES = (
    "one", "plus", "at", "spelled", "dots", "digits7", "digits8_15", "digits16_19", "digits20", "luhn", "parts4", "brackets",
    "spaces", "letter_before", "letter_after", "quote_before", "equals_before", "small_parts"
)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    at, past = text.find("@"), 0
    while at >= 0:
        a = at
        while a > past and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            past = m.end()
        at = text.find("@", max(past, at + 1))
    for m in _IP.finditer(text):
        if all(len(x) < 4 and int(x or 0) < 256 for x in (y.lstrip("0") for y in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 15:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


class Mention:
    __slots__ = ("end", "key", "label", "start", "x")

    def __init__(self, text: str, start: int, end: int, label: int | None):
        s = text[start:end]
        self.start, self.end, self.label = start, end, label
        digits = _NO_DIGIT.sub("", s)
        n = len(digits)
        spelled = "@" not in s and bool(re.search(r"(?i)[(\[{]at[)\]}]", s))
        if "@" in s or spelled:
            self.key = "@" + re.split(r"(?i)@|\s?[(\[{]at[)\]}]", s)[0].lower()
        else:
            self.key = digits[-7:]
        parts = s.split(".")
        before, after = text[max(0, start - 3) : start], text[end : end + 1]
        address = "@" in s or spelled
        self.x = np.array([
            1, text[start : start + 1] == "+", "@" in s, spelled, s.count(".") >= 3, n == 7, 8 <= n <= 15, 16 <= n <= 19, n > 19, not address and 16 <= n <= 19 and luhn(digits),
            len(parts) == 4, "(" in s, " " in s, before[-1:].isalpha(), after.isalpha(), before[-1:] in "\"'" if before else False, "=" in before, all(p.isdigit() and len(p) < 4 for p in parts),
        ], float)


def _groups(m: re.Match) -> Iterator[tuple[int, int]]:
    """A group of 7 to 19 digits as it stands; a longer one by the parts that spaces part."""
    if len(_NO_DIGIT.sub("", m[0])) <= 19:
        yield m.span()
        return
    for x in re.finditer(r"[^ ]+", m[0]):
        if 7 <= len(_NO_DIGIT.sub("", x[0])) <= 19:
            yield m.start() + x.start(), m.start() + x.end()


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[Mention]:
    """Base spans, and looser finds that overlap none of them, in order of their starts."""
    out = [Mention(text, a, b, 1 + KINDS.index(k)) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], int)
    ends = np.maximum.accumulate(np.array([b for _, b in taken], int)) if taken else starts
    loose = [x for m in _LOOSE.finditer(text) for x in _groups(m)]
    for a, b in [*loose, *_spelled(text)]:
        i = int(np.searchsorted(starts, b))
        if not i or ends[i - 1] <= a:
            out.append(Mention(text, a, b, None))
    return sorted(out, key=lambda x: (x.start, x.end))


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a spelled-out at sign, by their at signs: name(at)host.org, name [at] host (dot) org."""
    past = 0
    for m in _SPELLED.finditer(text):
        a = m.start()
        while a > past and text[a - 1] in _LOCAL:
            a -= 1
        domain = _SPELLED_DOMAIN.match(text, m.end()) if a < m.start() else None
        if domain:
            past = domain.end()
            yield a, past


def edges(found: list[Mention], reach: int = 60) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain, skip) edges; mentions with one key are joined to a hub each, numbered after them, so edges are as few as mentions."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1].start - found[i].end <= reach]
    by: dict[str, list[int]] = {}
    for i, m in enumerate(found):
        if len(m.key) >= 4:
            by.setdefault(m.key, []).append(i)
    shared = [x for x in by.values() if len(x) > 1]
    return chain, [(i, len(found) + h) for h, x in enumerate(shared) for i in x]


class Field:
    """Weights of the features (labels x features) and the two edge potentials (labels x labels), in logs."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    def marginals(self, found: list[Mention], rounds: int | None = None) -> np.ndarray:
        """mentions x labels, by loopy message passing (exact where the graph has no loop) in as many rounds as the graph has nodes at most, and some."""
        own = np.array([m.x for m in found]) @ self.weights.T
        for i, m in enumerate(found):
            if m.label is not None:
                own[i] = -30.0
                own[i, m.label] = 0.0
            else:
                own[i, 0] += DOUBT
        chain, skip = edges(found)
        both = [*chain, *skip]
        if not both:
            return _soft(own)
        if skip:
            given = np.zeros((skip[-1][1] + 1 - len(found), own.shape[1]))
            for i, h in skip:
                if found[i].label is not None:
                    given[h - len(found), found[i].label] += 1
            known = given.sum(1) > 0
            given[known] = np.where(given[known] > 0, 0.0, NEVER)
            own = np.concatenate([own, given])
        potential = np.array([self.chain] * len(chain) + [self.skip] * len(skip))
        a, b = (np.array(x) for x in zip(*both, strict=True))
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        potential = np.concatenate([potential, potential.transpose(0, 2, 1)])  # from the source's label to the target's
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        message = np.zeros((len(source), own.shape[1]))
        for _ in range(100 + len(own) if rounds is None else rounds):
            belief = own.copy()
            np.add.at(belief, target, message)
            rest = belief[source] - message[back]
            new = _log_sum(rest[:, :, None] + potential)
            new -= new.max(1, keepdims=True)
            if np.abs(new - message).max() < 1e-4:
                break
            message = 0.3 * message + 0.7 * new
        belief = own.copy()
        np.add.at(belief, target, message)
        return _soft(belief[: len(found)])


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None, :]).sum(1))


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fitted(texts: list[str], ridge: float = 2.0, steps: int = 300) -> Field:
    """Feature weights by ridge-penalised maximum likelihood on base labels (loose finds: none); edges by label pairs."""
    size = len(KINDS) + 1
    rows, labels = [], []
    pairs = np.full((size, size), 0.5)
    own = np.ones(size)
    for t in texts:
        found = mentions(t, base_spans(t))
        known = [m.label or 0 for m in found]
        rows += [m.x for m in found]
        labels += known
        for i, j in edges(found)[0]:
            pairs[known[i], known[j]] += 1
        for k in known:
            own[k] += 1
    share = own / own.sum()
    chain = np.log(pairs / pairs.sum() / (share[:, None] * share[None, :])).clip(-1, 1)
    skip = np.full((size, size), -2.0)
    np.fill_diagonal(skip, 2.0)
    skip[0, 0] = 0.0  # that two like numbers are nothing says nothing
    weights = np.zeros((size, len(FEATURES)))
    if rows:
        x, y = np.array(rows), np.eye(size)[labels]
        for _ in range(steps):
            p = _soft(x @ weights.T)
            weights -= 2.0 * ((p - y).T @ x + ridge * weights) / len(x)
    return Field(weights, chain, skip)


def all_spans(text: str, field: Field, least: float = 0.5) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans), each by kind, then start."""
    base = base_spans(text)
    if not base and not _LOOSE.search(text) and not _SPELLED.search(text):
        return base, base
    found = mentions(text, base)
    more = []
    if any(m.label is None for m in found):
        for m, p in zip(found, field.marginals(found), strict=True):
            best = int(p.argmax())
            if m.label is None and best and p[best] >= least:
                more.append((KINDS[best - 1], m.start, m.end))
    return base, sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1])) if more else base


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def learned(docs: DataFrame, sample: int = 2_000, sample_chars: int = 20_000) -> Field:
    """The field fitted on the documents of least hash. Only hashes compete; the texts of the chosen go to the driver."""
    turn = F.xxhash64("doc_id", "text").alias("turn")
    likely = docs.select("text", turn).filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= sample_chars))
    last = likely.select("turn").distinct().orderBy("turn").limit(sample).agg(F.max("turn")).first()[0]
    if last is None:
        return fitted([])
    chosen = likely.filter(F.col("turn") <= last).dropDuplicates(["turn"])
    return fitted([r["text"] for r in chosen.orderBy("turn").select("text").collect()])


SPANS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def found(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, numbers of base spans, hash of the base spans, all spans, and how many were added."""
    field = field or learned(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for t in b.column(1):
                text = t.as_py()
                if not text or not _ANY.search(text):
                    row = (0, 0, 0, 0, nothing, "", 0)
                else:
                    base, spans = all_spans(text, field)
                    line = shown(base)
                    row = (
                        *(sum(k == x for k, _, _ in base) for x in KINDS), hashlib.sha256(line.encode()).hexdigest(),
                        shown(spans), len(spans) - len(base)
                    )
                for x, y in zip(out, row, strict=True):
                    x.append(y)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SPANS}, n_added long"
    )


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones joined, replaced by the kind of the first in brackets."""
    out, at = [], 0
    joined: list[list] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if joined and a < joined[-1][2]:
            joined[-1][2] = max(b, joined[-1][2])
        else:
            joined.append([k, a, b])
    for k, a, b in joined:
        out += [text[at:a], f"[{k}]"]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with personal data masked in text; other columns as they are, n_chars (if there) that of the new text."""
    field = field or learned(docs)
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, columns = [], list(b.columns)
            for t in b.column(text_at):
                text = t.as_py()
                if text and _ANY.search(text):
                    spans = all_spans(text, field)[1]
                    text = masked(text, spans) if spans else text
                texts.append(text)
            columns[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                columns[chars_at] = pa.array(
                    [None if t is None else len(t) for t in texts], pa.int64()
                ).cast(b.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op6_pii(spark, sf_dir):
    return found(table(spark, sf_dir, "documents"))
