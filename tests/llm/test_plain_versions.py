"""Operators whose results SQL cannot express, against plain versions written another way."""

import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_operators import documents, prose, slow_syncmers

from corpusmill.llm import html_text, mixing, packing, pii, quality, syncmers

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def contract_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(x[-4000:]) <= 255 and (len(x) < 4000) for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(CARD, text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(PHONE, text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_are_the_contracts_patterns():
    r = random.Random(6)
    parts = ["@", ".", "-", " ", "+", "1", "25", "255", "256", "0", "a", "b.c", "x@y.z", "4111 1111 1111 1111", "4111111111111111", "+1 (988) 555-2485", "1.2.3.4", "00", "%", "_", "\n", "é", "٣", "(", ")", "--", "  "]
    for _ in range(30_000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        assert pii.base_spans(text) == contract_spans(text), text
    assert pii.base_spans("1.2.3." + "0" * 5000 + "4") == [("ip", 0, 5007)]
    assert pii.all_spans("name(at)" + "a" * 5000 + ".org", pii.fitted([]))[0] == []


def test_spelled_addresses_of_any_length():
    long = "n" * 200
    for text in ("a.b (at) c-d (dot) org", f"{long}[at]{'h' * 100}.org", "x{AT}y.z"):
        whole = f"see {text}, ok"
        assert [whole[a:b] for a, b in pii._spelled(whole)] == [text]
    assert list(pii._spelled("(at) x.y and z(at) w")) == []
    began = __import__("time").perf_counter()
    list(pii._spelled("a" * 300_000 + "(at)" * 50_000))
    assert __import__("time").perf_counter() - began < 3


def test_quality_is_ridge_then_pooling(spark):
    """Sums by partition give what whole matrices give."""
    rows = [(i, prose(i, 30 + i % 90) if i % 3 else "#".join(prose(i, 40).upper())) for i in range(240)] + [(900, prose(5, 20_000)), (901, None), (902, "")]
    marks = [(i, int(bool(i % 3)) ^ (i % 17 == 0)) for i in range(0, 240, 2)] + [(900, 1), (900, 1), (901, 0), (4, 0)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(90), spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, labels).collect()}
    text, crc = dict(rows), lambda i: zlib.crc32(str(i).encode())
    train = [(i, y) for i, y in marks if crc(i) % 3 != 1]
    x, y = np.array([quality.statistics(text[i]) for i, _ in train]), np.array([y for _, y in train], float)
    fold = np.array([crc(i) % 5 == 0 for i, _ in train])
    mean, deviation = x.mean(0), np.sqrt(((x * x).mean(0) - x.mean(0) ** 2).clip(0)) + 1e-6
    z = lambda v: quality.fourier(((np.array(v) - mean) / deviation).clip(-6, 6))
    a, b = z(x[~fold]), y[~fold]
    weights = np.linalg.solve(a.T @ a + 1e-2 * np.eye(a.shape[1]), a.T @ b)
    bins = lambda raw: ((raw.clip(-0.5, 1.4999) + 0.5) / 2 * quality.BINS).astype(int)
    held, good = bins(z(x[fold]) @ weights), y[fold]
    seen = sorted(set(held.tolist()))
    steps = [[float(good[held == k].mean()), int((held == k).sum())] for k in seen]
    level = [max(min(np.average([m for m, _ in steps[i : j + 1]], weights=[w for _, w in steps[i : j + 1]]) for j in range(k, len(steps))) for i in range(k + 1)) for k in range(len(steps))]
    curve = np.interp(np.arange(quality.BINS), seen, level)
    raw = z([quality.statistics(t) for _, t in rows]) @ weights
    want = (0.998 * curve[bins(raw)] + 0.002 / (1 + np.exp(-4 * (raw - 0.5)))).clip(0, 1)
    assert np.mean(np.abs(np.array([got[i] for i, _ in rows]) - want) < 1e-6) > 0.99  # a score at a bin's edge may fall to either side


def plain_fingerprint(text: str) -> list:
    raw, slots = text.encode(), [None] * syncmers.SLOTS
    if 0 < len(raw) < syncmers.K:
        import hashlib

        hashes = [int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")]
    else:
        hashes = [int(syncmers.window_hashes(np.frombuffer(raw[i : i + syncmers.K], np.uint8), (syncmers.K,))[0][0]) for i in slow_syncmers(raw, syncmers.K, syncmers.S)]
    for h in hashes:
        x = int(syncmers.mix(np.array([h], np.uint64) * np.uint64(syncmers.MULT))[0])
        slot, value = x >> 58, x & 0xFFFFFFFF
        value = 0 if value == 0xFFFFFFFF else value
        slots[slot] = value if slots[slot] is None else min(slots[slot], value)
    return slots


def test_fingerprints_and_likenesses(spark):
    texts = [(i, t) for i, t, _ in documents() if len(t or "") < 700] + [(5, "another text under that id, long enough for some anchors"), (None, "no id"), (None, "no id, either")]
    docs = spark.createDataFrame([(i, t, "m") for i, t in texts], "doc_id long, text string, mark string")
    got = syncmers.compared(docs, part_bytes=600).collect()
    turn = {r["text"] or "": r["h"] for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in texts), key=lambda x: (x[0] is None, -(x[0] or 0), turn[x[1]], x[1]))
    as_hex = lambda slots: "".join("ffffffff" if s is None else f"{s:08x}" for s in slots)

    def like(a, b):
        used = sum(x is not None or y is not None for x, y in zip(a, b, strict=True))
        return sum(x == y and x is not None for x, y in zip(a, b, strict=True)) / used if used else 1.0

    want = Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        one, two, three = (plain_fingerprint(x) for x in (t, t[: len(t) - len(t) // 2] + after[: len(t) // 2], after))
        want[i, len(t), as_hex(one), as_hex(two), round(like(one, two), 9), round(like(one, three), 9)] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want


def test_mixing_by_hand(spark):
    rows = [(i, prose(i, 5 + i % 60), f"s{i % 5}" if i % 11 else None) for i in range(300)] + [(7, prose(7, 12), "s2")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    turns = {(r["doc_id"], r["text"]): (r["turn"], r["mark"]) for r in docs.select("doc_id", "text", F.xxhash64(F.lit(7), "doc_id", "text").alias("turn"), F.xxhash64("text").alias("mark")).collect()}
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    names = sorted(s for s in size if s) + [None]
    total, want = sum(size.values()), dict(zip(names, mixing.targets([size[s] for s in names]), strict=True))
    block = max(1, min(128, total // (200 * len(names))))

    def seats(shares, n):
        got = [0] * len(shares)
        for _ in range(n):
            got[max(range(len(shares)), key=lambda i: (shares[i] / (2 * got[i] + 1), -i))] += 1
        return got

    expected = Counter()
    for s, n in zip(names, seats([want[s] for s in names], round(sum(want.values()) / block)), strict=True):
        many = max(1, math.ceil(size[s] / 400))
        shards: dict[int, list] = {}
        for i, t, source in rows:
            if source == s:
                shards.setdefault(turns[i, t][0] % many, []).append((turns[i, t][0], i, turns[i, t][1], len(t.split())))
        places = sorted(shards)
        words = [sum(x[3] for x in shards[k]) for k in places]
        for k, w, g in zip(places, words, seats(words, n), strict=True):
            quota = min(g * block, 3 * w, math.ceil(want[s]))
            rounds, left = divmod(quota, w)
            for _, i, _, n_words in sorted(shards[k]):
                part = min(n_words, left)
                left -= part
                expected[i, n_words, rounds * n_words + part] += 1
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.taken(docs, shard_words=400).collect()) == expected


def made_page(r: random.Random) -> tuple[str, str]:
    """A page of known text: an article of blocks in one of several wrappers, among what is no article."""
    mark = lambda s: re.sub(r"\b(\w{5,})\b", lambda m: r.choice([m[0], f"<b>{m[0]}</b>", f"<a href='/x?id={r.randrange(9)}'>{m[0]}</a>" if r.random() < 0.1 else m[0]]), s)
    blocks, shown = [], []
    for k in range(r.randrange(3, 9)):
        s = prose(r.randrange(10**6), r.randrange(18, 70)).capitalize() + r.choice([".", " & more.", " — 5 < 6?", " «é»!"])
        shown.append(" ".join(s.split()))
        inner = mark(html.escape(s, quote=False)).replace(" ", r.choice([" ", "\n  ", " "]), 3)
        blocks.append(r.choice(["<p>{}</p>", "<p class=x data-a=\"it's\">{}</p>", "<blockquote>{}</blockquote>", "<p title=don't>{}", "<pre>{}</pre>"]).format(inner))
        if not k % 4:
            blocks.append("<script>if (a < b) { x('</p>'); }</script><!-- <p>gone, gone, gone</p> -->")
    menu = "<nav><ul><li><a href=/>Home</a><li><a href=/a>All of it</a></ul></nav>"
    head = f"<header class=site-header><div>{menu}</div></header>"
    noise = ["<aside class='sidebar'><h3>More</h3><ul><li><a href='/1'>One, two, three</a></li></ul></aside>", "<div class=cookie-notice><p>We use cookies, as all do, here and there.</p></div>", "<form action=/s><input name=q><button>Search</button></form>"]
    after = ["<div id=comments><p>Nice, nice, really nice, I say.</p><p>Thanks, all of you, for this one.</p></div>", "<footer><p>&copy; 2024, all of us</p></footer>", "<div class='related-posts'><a href=/z>Another one, with a long enough title</a></div>"]
    wrap = r.choice(["<article>{}</article>", "<main><div class=content>{}</div></main>", "<div id='content' class='post has-sidebar'>{}</div>", "<div class=entry-content>{}</div>"])
    r.shuffle(noise), r.shuffle(after)
    return f"<!doctype html><html><head><title>x</title><style>p > a {{}}</style></head><body>{head}{noise[0]}{wrap.format(''.join(blocks))}{''.join(noise[1:])}{''.join(after)}</body></html>", "\n".join(shown)


def test_articles_come_back_whole(spark):
    r = random.Random(12)
    pages = [made_page(r) for _ in range(120)]
    pages += [("<article>" + "".join(f"<p>{prose(i, 400)}</p>" for i in range(300)) + "</article>", "\n".join(prose(i, 400) for i in range(300)))] * 2
    df = spark.createDataFrame([(i, "u", p, 0, "t") for i, (p, _) in enumerate(pages)], "page_id long, url string, html string, n_chars int, text string")
    got = {x["page_id"]: x["text"] for x in html_text.extracted(df).collect()}
    assert len(got) == len(pages)
    wrong = [i for i, (_, want) in enumerate(pages) if got[i] != want]
    assert not wrong, (got[wrong[0]], pages[wrong[0]])
    assert html_text.extracted(df.limit(0)).count() == 0


def test_packing_pads_little(spark):
    docs = spark.createDataFrame([(i, prose(i, 50 + i * 7 % 900)) for i in range(400)], "doc_id long, text string").coalesce(1)
    pieces = packing.packed(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    padding = sum(0 if x["n"] & (x["n"] - 1) == 0 else 1024 - x["n"] for x in pieces)
    assert padding < 0.02 * sum(x["n"] for x in pieces) and max(x["n"] for x in pieces) <= 1024
