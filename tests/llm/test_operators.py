"""The ten operators against plain versions on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import html_text, jaccard, mixing, ngram_lm, packing, pii, quality, suffix_dedup, syncmers, vectors
from corpusmill.llm.components import components

WORDS = [f"{a}{b}" for a in "ka lo mi ne pu ra si to".split() for b in "b cd fgh x yz".split()]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def documents() -> list[tuple]:
    base = [prose(i, 20 + 13 * i) for i in range(14)]
    rows = [(i, t, "s" + str(i % 3)) for i, t in enumerate(base)]
    rows += [(20, base[5], "s1"), (21, base[9].replace(WORDS[3], "changed"), "s0"), (22, base[9][:400] + prose(99, 30), None), (23, None, "s2"), (24, "", "s2"), (25, " \t\n ", None), (26, "one", "s1")]
    rows += [(27, prose(5, 3000) + " " + base[9], "s0"), (28, "ab " * 200, "s0"), (29, "two words", "s1"), (5, base[5], "s2"), (30, "écrit à côté été 漢字 " * 40, "s2"), (31, prose(7, 50).upper(), "s2")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, 1, 0) for i, t, s in documents()], "doc_id long, text string, source string, n int, bytes int").repartition(3)


def test_language_model(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    is_held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    texts = [(i, ngram_lm.words_of(t) + [ngram_lm.END]) for i, t, _ in documents()]
    train = [w for i, w in texts if not is_held(i)]
    counts = [Counter(), Counter(), Counter()]
    for w in train:
        own = [ngram_lm.START, *w]
        counts[0].update(w)
        counts[1].update(zip(own, own[1:], strict=False))
        counts[2].update(zip(own, own[1:], own[2:], strict=False))
    n, v, m = sum(counts[0].values()), len(counts[0]), 3.0

    def p(w, h):
        if not h:
            return (counts[0][w] + 0.1) / (n + 0.1 * (v + 1))
        seen = counts[len(h) - 1][h] if len(h) > 1 else len(train) if h == (ngram_lm.START,) else counts[0][h[0]]
        return (counts[len(h)][(*h, w)] + m * p(w, h[1:])) / (seen + m)

    for order in (2, 3):
        got = sorted(tuple(r) for r in ngram_lm.scored(docs, held, order=order, prior=m, chunk_bytes=2000, keys_a_bucket=500).collect())
        want = []
        for i, w in texts:
            own = [ngram_lm.START, *w]
            score = sum(math.log10(p(own[k], tuple(own[max(0, k - order + 1) : k]))) for k in range(1, len(own)))
            want.append((i, is_held(i), len(w), sum(counts[0][x] > 0 for x in w), n, sum(math.log10(p(x, ())) for x in w), score))
        want.sort()
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want])


def test_language_model_empty(spark, docs):
    assert ngram_lm.scored(docs.limit(0), F.lit(False)).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (None, " ")], "doc_id long, text string")
    got = ngram_lm.scored(none, F.lit(False)).collect()
    assert len(got) == 3 and all((r["n_tokens"], r["n_known"], r["train_tokens"]) == (1, 1, 3) for r in got)
    base = math.log10(3.1 / 3.2)
    assert all(abs(r["base_score"] - base) < 1e-12 and abs(r["score"] - math.log10((3 + 200 * 10**base) / 203)) < 1e-12 for r in got)


def vector_rows() -> list[tuple]:
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 8))
    rows = [(i, base[i].tolist(), i % 2) for i in range(60)]
    rows += [(100 + i, (base[i % 7] + r.normal(size=8) * 0.06).tolist(), (i % 7) % 2) for i in range(80)]
    rows += [(300, base[3].tolist(), 1), (301, base[3].tolist(), 1), (302, (base[3] * 5).tolist(), 1), (303, None, 1), (304, [0.0] * 8, 1), (305, [1.0, None] * 4, 1), (306, [float("nan")] * 8, 0), (307, base[3].tolist(), None), (308, [1.0, 2.0], 1), (309, [1.0, 2.0], 1), (310, [], 1)]
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df, sample=50, lists=5, block=block).collect()}
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x in rows}
    links = {i: {j for j in ok if i in ok and j != i and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.98} for i, _, _ in rows}
    least = {i: i for i in links}
    for _ in links:
        least = {i: min([least[i], *(least[j] for j in links[i])]) for i in links}
    assert sum(map(len, links.values())) > 100
    assert got == {i: (len(links[i]), least[i], least[i] == i) for i in links}
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_where_hashes_clash_and_columns_too(spark):
    rows = [(i, v, label, i, 1.0) for i, v, label in vector_rows()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int, vec double")
    got = sorted(tuple(r) for r in vectors.near_duplicates(df).collect())
    assert got == sorted(tuple(r) for r in vectors.near_duplicates(df, node_bits=4).collect())


def test_vectors_of_extreme_components(spark):
    tiny, huge = 5e-324, 1.7e308
    rows = [(1, [tiny, 0.0]), (2, [huge, 0.0]), (3, [huge, huge]), (4, [tiny, tiny]), (5, [0.0, -tiny]), (None, [0.0, -3.0]), (None, [9.0, -9.0]), (None, [9.0, -9.0])]
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<double>, label string")
    got = sorted((tuple(r) for r in vectors.near_duplicates(df).collect()), key=str)
    want = [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (None, 1, 5, False), (None, 1, None, True), (None, 1, None, True)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("a_cell", [8, 256])
def test_probes_reach_every_near_vector(a_cell):
    """Of vectors in 64 lists: those within the radius of one another are in a list that either probes."""
    r = np.random.default_rng(5)
    x = vectors.unit([v.tobytes() for v in np.repeat(r.normal(size=(300, 6)), 3, axis=0) + r.normal(size=(900, 6)) * 0.12])
    index = vectors.Index(x[::2], 64, 0.98, a_cell)
    own, probes = index.assigned(x)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    assert len(i) > 300 and len(set(own.tolist())) > 40
    assert all((own[b] in probes[a]) if own[a] <= own[b] else (own[a] in probes[b]) for a, b in zip(i, j, strict=True))


def test_segment_ids_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = packing.SegmentEncoder()
    odd = ["", " ", "  a", "a  b", "a \n b\n\n c ", "it's we'll x", "foo. bar, baz; ", "\x1c a \x1cb", "x　 　y  z", "<|endoftext|> a", "a<|endoftext|>", "a <|endoftext|>  b <|endoftext|><|endoftext|>c", "<|endoftext|", "½ ² a1b2 _x_ é́", "a\r\n b\t c", "日本 語。"]
    for x in [*odd, *(t or "" for _, t, _ in documents())]:
        assert np.frombuffer(e.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_cuts_are_optimal():
    r = random.Random(1)
    for _ in range(60):
        at = np.array([0, *sorted(r.sample(range(1, 60), 14))])
        at = at[np.concatenate([[True], np.diff(at) <= 16])] if (np.diff(at) <= 16).all() else np.arange(0, 60, 4)
        pen = np.array([r.randrange(4) for _ in at], float)
        best = [0.0] + [math.inf] * (len(at) - 1)
        cost = lambda n: 0 if n in (1, 2, 4, 8) else 16 - n
        for j in range(1, len(at)):
            best[j] = min(best[i] + cost(at[j] - at[i]) + pen[j] + 2 for i in range(j) if at[j] - at[i] <= 16)
        cuts = packing.choose_cuts(at, pen, 16, opening=2)
        got = sum(cost(at[b] - at[a]) + pen[b] + 2 for a, b in zip(cuts, cuts[1:], strict=False))
        assert got == best[-1]


def test_packing_round_trip(docs):
    rows = packing.packed(docs, width=64, reach=8, stretch=3000, with_ids=True).collect()
    e = packing.SegmentEncoder()
    by = {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by.setdefault(r["doc_id"], []).append(r)
    want = Counter()
    for i, t, _ in documents():
        want[i, e.ids(t or "") + b"\0\0\0\0"] += 1
    got = Counter()
    for i, own in by.items():
        own.sort(key=lambda r: (r["sequence_id"], r["offset"]))
        at = [k for k, r in enumerate(own) if not r["start"]]
        for a, b in zip(at, [*at[1:], len(own)], strict=True):  # repeated rows follow one another in their stream
            got[i, np.array([x for r in own[a:b] for x in r["ids"]], "<u4").tobytes()] += 1
            assert all(r["doc_tokens"] == sum(x["length"] for x in own[a:b]) for r in own[a:b])
    assert got == want
    assert packing.packed(docs.limit(0)).count() == 0
    special = docs.limit(1).select("doc_id", F.lit("a <|endoftext|> b").alias("text"))
    assert packing.packed(special, with_ids=True).first()["ids"][1:3] == [220, 50256]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64


def removed(rows: list[tuple], length: int) -> dict:
    """Bytes that go, string by string."""
    texts = sorted({(i, t or "") for i, t, _ in rows})
    seen, out = set(), {}
    for i, t in texts:
        raw = t.encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = [True] * length
            seen.add(s)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("length", "hot"), [(100, 20_000), (60, 2)])
def test_suffixes(docs, length, hot):
    want = removed(documents(), length)
    assert sum(w[1] for w in want.values()) > 1000
    got = suffix_dedup.without_repeats(docs, length, hot=hot, block_bytes=3000).collect()
    assert len(got) == len(documents())
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


@pytest.mark.parametrize("length", [40, 64, 100, 129])
def test_doubling(length):
    r = random.Random(length)
    data = bytes(r.choice(b"ab") for _ in range(500)) * 2 + bytes(r.choice(b"abc") for _ in range(600)) + b"a" * 300
    starts = np.array(sorted(r.sample(range(len(data) - length + 1), 900)))
    rank = suffix_dedup.doubled(np.frombuffer(data, np.uint8), starts, length)
    strings = [data[x : x + length] for x in starts.tolist()]
    many = Counter(strings)
    assert [x >= 0 for x in rank] == [many[x] > 1 for x in strings] and max(many.values()) > 1
    ranks = {x: k for x, k in zip(strings, rank.tolist(), strict=True) if k >= 0}
    assert len(set(ranks.values())) == len(ranks) and all(ranks[x] == k for x, k in zip(strings, rank.tolist(), strict=True) if k >= 0)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_traversal_side_by_side_is_that_token_by_token(order):
    r = random.Random(order)
    texts = [[f"w{int(r.expovariate(0.3))}" for _ in range(r.choice([0, 1, 2, 40]))] for _ in range(60)]
    names = sorted({w for t in texts for w in t} | {"\n"})
    tokens = np.array([names.index(w) for t in texts for w in [*t, "\n"]], np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    train = np.arange(60) % 3 > 0
    chunk = ngram_lm.Chunk({
        "ids": np.arange(60).tobytes(), "held": np.packbits(np.concatenate([train, np.zeros(60, bool)])).tobytes(), "ends": ends.tobytes(),
        "words": (np.arange(1, len(names) + 1, dtype=np.uint64) * np.uint64(ngram_lm.MULT)).tobytes(), "tokens": ngram_lm._planes(tokens),
    }, order)
    counts = [own for _, own in chunk.sets]
    m = ngram_lm.Automaton(chunk, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), int(train.sum()), 200.0)
    want, a, fails = [], 0, 0
    for e in ends.tolist():
        state, score = m.start, 0.0
        for i in range(a, e):
            while m.arcs[m.depth[state]][i] < 0:
                score, state, fails = score + m.fail[state], m.back[state], fails + 1
            arc = m.arcs[m.depth[state]][i]
            score, state = score + m.weight[arc], m.into[arc]
        want.append(score)
        a = e
    assert m.traverse().tolist() == pytest.approx(want) and (fails > 0) == (order > 1)


def test_suffixes_rank_some_names_at_a_time():
    """The memory of a group does not grow with its anchors; the last name, with more anchors than go at a time, stays whole."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(1)
    base = [r.integers(97, 123, 135, dtype=np.uint8).tobytes() for _ in range(6000)]
    name = np.concatenate([np.arange(18_000) % 6000, np.full(6000, 5999)])
    n = len(name)
    part = pa.table({"name": name, "doc_id": np.arange(n), "mark": np.zeros(n, np.int64), "place": np.zeros(n, np.int64), "span": pa.array([base[i] for i in name], pa.binary())})
    tracemalloc.start()
    got = suffix_dedup._resolved(100)(part).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160e6
    assert sorted(got["doc_id"]) == list(range(6000, n)) and set(got["start"]) == {0} and set(got["stop"]) == {135}


def test_suffixes_of_long_texts_and_of_no_rows(spark):
    """Repeats across the seams of tiles."""
    body = prose(1, 60_000)
    assert len(body) > suffix_dedup.TILE
    rows = [(1, body, "x"), (2, prose(2, 40) + body[suffix_dedup.TILE - 150 : suffix_dedup.TILE + 150] + prose(3, 40), "y"), (3, body[5:], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    want = removed(rows, 100)
    assert want[2][1] >= 300 and want[3][1] == len(body) - 5
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.without_repeats(docs).collect()} == want
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice"><p>We use cookies, please, accept, all of them, now.</p></div><div class=ad>Buy, buy, buy, this, now.</div>
<article><h1>Title &amp; more</h1><p>One,   two,\nthree.<br>Four <b>five</b></p><script>var x="</p>";</script><!-- c --><ul><li>a<li>b</ul><aside>side</aside><p>Last &#233;.</article>
<div id="comments"><p>Nice, nice, really, really nice article, thanks, a lot.</p></div><form><p>Sign up</p></form><footer>&copy; foot</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "plain &lt;text&gt;"), (5, "u", "<div>" * 3000 + "deep text here" + "</div>" * 10), (6, None, '<p title="x>y">a</p><p')], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extracted(pages).collect()}
    want = {1: "Title & more\nOne, two, three. Four five\na\nb\nLast é.", 2: "", 3: "", 4: "plain <text>", 5: "deep text here", 6: "a"}
    assert got == {k: (v, len(v)) for k, v in want.items()}


@pytest.mark.parametrize("name", ["content no-sidebar", "site has-header", "layout-with-sidebar", "post has-comments", "post type-post category-legal", "page header", "main-search", "site hidden", "social"])
def test_html_wrappers_named_like_noise(name):
    text = ["A title of some length", "One, two, three and so on, for a while at least.", "The last one, which is no shorter than that."]
    noise = '<div id="comments"><p>Nice, nice.</p></div><div class="cookie-notice"><p>We use them.</p></div>'
    inner = f'<div class="entry-header"><h1>{text[0]}</h1></div><p>{text[1]}</p><p>{text[2]}</p>'
    for body in (f'<div class="{name}">{inner}{noise}</div>', f'<div class="{name}"><article>{inner}</article></div>{noise}', f'<form action="x"><div class="{name}">{inner}</div>{noise}</form>'):
        assert html_text.main_text(f"<html><body><nav>Menu</nav>{body}</body></html>").split("\n") == text
    assert html_text.main_text('<div class="sidebar"><a href="/a">All there is</a></div>') == "All there is"
    cards = "".join(f'<article class="card"><p>Another one, {i}.</p></article>' for i in range(3))
    assert html_text.main_text(f'<article><p>{text[1]}</p><p>{text[2]}</p></article><div class="related">{cards}</div>').split("\n") == text[1:]


@pytest.mark.parametrize("attributes", ['href="https://x.org/hidden-figures"', 'title="A hidden gem"', 'data-hidden="false"', 'href="/p?id=comments"', "data-x='class=sidebar'", 'data-id="comments"', "title='style=\"display:none\"'", "data-a=role=search"])
def test_html_attributes_by_exact_name(attributes):
    text = ["One, two, three and so on, for a while at least.", "The last one, which is no shorter than that."]
    assert html_text.main_text(f"<article><p>{text[0]}</p><div {attributes}><p>{text[1]}</p></div></article>").split("\n") == text
    assert html_text.main_text(f"<article><p>{text[0]} <a {attributes}>{text[1]}</a></p></article>") == " ".join(text)


def test_html_quotes_and_broken_tags():
    a, b, c = "First one, and so on, for a while at least.", "It isn't the last one, which is no shorter.", "Third one, with some more words to it."
    for attributes in ("title=don't", "title=a\"b", "title = 'a>b' x", "title=\"a'>\"", "a=b'c' d", "title='it\"s'class=x", "=x", "/ /", "a='1'b=\"2\"c=3"):
        assert html_text.main_text(f"<article><p {attributes}>{a}</p><p>{b}</p><p>{c}</p></article>").split("\n") == [a, b, c], attributes
    assert html_text.main_text(f'<article><p>{a}</p><p title="never closed>{b}</p><p>{c}</p></article>').split("\n") == [a, b, c]
    assert html_text.main_text(f"<article><p>{a}</p><!-- x > y --><p>{b}<!--></p><p>{c}</p><!-- open").split("\n") == [a, b, c]
    assert html_text.main_text("<p>&#65;&#0000000000000000000065;&#" + "9" * 5000 + ";&#x" + "f" * 5000 + ";&#" + "0" * 5000 + "66;</p>") == "AA\ufffd\ufffdB"


def test_html_takes_time_in_proportion():
    import time

    sides = ["<a " * 100_000, '<a b="' * 50_000, "<a b='c\" " * 50_000, "</script " * 50_000, "<script></script " * 50_000, "<!--" * 50_000, "<p x=" * 50_000, "<" * 200_000, "&#" * 100_000, "<li>" * 50_000, "<div>" * 50_000]
    for side in [*sides, "".join(f"<p>{prose(i, 60)}</p>" for i in range(14_000))]:
        began = time.perf_counter()
        html_text.main_text(f"<article><p>One, two.</p>{side}")
        assert time.perf_counter() - began < 8, side[:20]


def test_html_hidden_and_self_closed():
    for attributes in ("hidden", "HIDDEN", "a=b hidden=''", "a = 'b'style='display: none'", 'class=x aria-hidden="true"', "/ID=comments", 'class="x\ncomments y"'):
        assert html_text.main_text(f"<article><p>One, two.</p><div {attributes}><p>Gone.</p></div></article>") == "One, two.", attributes
    for tag in ("<svg class='i'/>", "<math/>", '<svg viewBox="0 0 1 1" />', "<svg><path d='M0'/>gone</svg>"):
        assert html_text.main_text(f"<article><p>One, {tag}two.</p><p>Three.</p></article>") == "One, two.\nThree.", tag


def test_personal_data(spark):
    texts = [None, "", "mail a.b@c-d.org, x@y, ip 1.2.3.4 and 1.2.3.999 card 4111 1111 1111 1111 or 4111111111111112 tel +1 (988) 555-2485, later (988) 555-2485", "clean words only", "a@b@c.com 1.2.3.4.5.6.7.8", "9" * 5000 + " " + "a" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)]
    field = pii.fitted([texts[2].split(", later")[0]] * 30 + ["number 12345678 here", "x 99999999999 y"] * 30)
    got = {r["doc_id"]: r for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    t = texts[2]
    span = lambda k, s: f"{k}:{t.index(s)}:{t.index(s) + len(s)}"
    base = [span("email", "a.b@c-d.org"), span("ip", "1.2.3.4"), span("card", "4111 1111 1111 1111"), span("phone", "+1 (988) 555-2485")]
    assert got[2]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
    later = t.rindex("(988) 555-2485")
    assert got[2]["spans"].split(",") == [*base, f"phone:{later}:{later + 14}"]
    assert [got[2][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 1, 1]
    assert got[4]["spans"] == "email:2:9,ip:10:17,ip:18:25"
    assert all(got[i]["spans"] == "" for i in (0, 1, 3))
    assert pii.masked(t, pii.base_spans(t)).startswith("mail [email], x@y, ip [ip] and 1.2.3.999 card [card] or")
    clean = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    assert pii.redacted(clean, field).columns == clean.columns and pii.redacted(clean.limit(0), field).count() == 0


@pytest.mark.parametrize("gap", [" and then some words that part the mentions from one another by more than the chain reaches ", " or "])
def test_all_repeats_of_a_number_are_labelled_alike(gap):
    field = pii.fitted(["tel +1 (988) 555-2485 here"] * 30 + ["number 12345678 here", "x 99999999999 y"] * 30)
    field.weights[:] = 0
    field.chain[:] = 0
    like = "(988) 555-2485"
    for before, after in ((0, 50), (25, 25), (400, 1)):
        text = gap.join([like] * before + ["+1 " + like] + [like] * after)
        found = pii.mentions(text, pii.base_spans(text))
        assert len(found) == before + after + 1
        field.weights[0, 0] = 2.0 - pii.DOUBT  # none is likelier by 2 nats
        p = np.delete(field.marginals(found)[:, 1 + pii.KINDS.index("phone")], before)
        assert p.min() > 0.8 and np.ptp(p) < 1e-6
        assert len(pii.all_spans(text, field)[1]) == before + after + 1 and like not in pii.masked(text, pii.all_spans(text, field)[1])
    text = gap.join([like] * 50)
    assert pii.all_spans(text + " 12345678", pii.fitted(["number 12345678 here"] * 30))[1] == []


def test_personal_data_of_odd_tables(spark):
    rows = [(1, "1.2.3.4 and +1 (988) 555-2485", 5), (1, "1.2.3.4 and +1 (988) 555-2485", 5), (None, "+4111111111111111", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int").withColumn("n_email", F.lit("x"))
    got = pii.found(df).collect()
    assert [r["spans"] for r in got if r["doc_id"] == 1] == ["ip:0:7,phone:12:29"] * 2
    assert [(r["n_card"], r["n_phone"]) for r in got if r["doc_id"] is None] == [(1, 0)]  # the card lies in a longer phone number
    assert pii.found(df.limit(0)).count() == 0


def test_messages_are_exact_on_trees():
    field = pii.Field(np.random.default_rng(0).normal(size=(5, len(pii.FEATURES))), np.random.default_rng(1).normal(size=(5, 5)), np.random.default_rng(2).normal(size=(5, 5)))
    text = "a 12345678 b 87654321 c 5551234567"
    found = pii.mentions(text, [])
    assert len(found) == 3
    own = np.array([m.x for m in found]) @ field.weights.T
    own[:, 0] += pii.DOUBT
    joint = np.exp(own[0][:, None, None] + own[1][None, :, None] + own[2][None, None, :] + field.chain[:, :, None] + field.chain[None, :, :])
    joint /= joint.sum()
    want = [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))]
    assert np.allclose(field.marginals(found, 60), want, atol=1e-3)


def test_quality(spark):
    good = [(i, prose(i, 80 + i % 40), "x") for i in range(300)]
    bad = [(1000 + i, "".join(c.upper() + "##" for c in prose(i, 60).split(" ")), "x") for i in range(100)]
    rows = [*good, *bad, (5000, None, "x"), (5001, "", "x"), (3, good[3][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good[::2]] + [(i, 0) for i, _, _ in bad[::2]] + [(7, None), (9, 5)], "doc_id long, quality int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 5000]
    assert np.mean([(r["doc_id"] < 1000) == (r["predicted"] == 1) for r in held]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}
    assert {r["score"] for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_pooling():
    assert quality.pooled(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)).tolist() == [1.0, 2.5, 2.5, 4.0]


def test_apportionment():
    r = random.Random(2)
    for _ in range(50):
        shares, seats = [r.choice([0, 1, 2, 5, 5.5, 100]) for _ in range(6)], r.randrange(80)
        got = [0] * 6
        for _ in range(seats if sum(shares) else 0):
            got[max(range(6), key=lambda i: (shares[i] / (2 * got[i] + 1), -i))] += 1
        assert mixing.sainte_lague(np.array(shares), seats).tolist() == got


def test_mixing(spark, docs):
    rows = documents()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    names = sorted(s for s in sizes if s) + [None]
    want = dict(zip(names, mixing.targets([sizes[s] for s in names]), strict=True))
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6 and all(want[s] <= 3 * sizes[s] + 1e-9 for s in names)
    for words in (1 << 21, 300):
        got = mixing.taken(docs, shard_words=words).collect()
        assert len(got) == len(rows)
        source = {(i, len((t or "").encode().split())): s for i, t, s in rows}
        sums = Counter()
        for r in got:
            s = source[r["doc_id"], r["size"]]
            assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
            sums[s] += r["taken"]
        assert all(abs(sums[s] - want[s]) <= 0.02 * want[s] + 10 for s in names)
        assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in mixing.taken(docs, shard_words=words).collect())
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns
    made = Counter()
    for r in whole.collect():
        made[r["source"]] += len((r["text"] or "").encode().split())
    assert made == Counter({s: n for s, n in sums.items()}) or all(abs(made[s] - want[s]) <= 0.02 * want[s] + 10 for s in names)
    assert mixing.taken(docs.limit(0)).count() == 0


def test_mixing_of_equal_sources_and_of_rows_without_id(spark):
    rows = [(None, prose(i, 40), f"s{i % 6}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums, want = Counter(), {}
    words = {t: s for _, t, s in rows}
    for r in mixing.mixed(docs, shard_words=500).collect():
        sums[r["source"]] += len(r["text"].split())
    for r in mixing.taken(docs, shard_words=500).collect():
        assert r["source_size"] == 4000
        want[r["target"]] = want.get(r["target"], 0) + 1
    assert len(words) == 600 and set(want.values()) == {200} and max(want) / min(want) == 5
    assert [round(sums[f"s{i}"] / sums["s2"]) for i in range(6)] == [5, 2, 1, 5, 2, 1]


def shingle_set(t, n):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("words", "percent", "block"), [(4, 85, 1500), (5, 80, 1500), (4, 85, 3)])
def test_jaccard(spark, words, percent, block):
    rows = [(i, t) for i, t, _ in documents()]
    r = random.Random(8)
    base = prose(77, 260).split()
    for i in range(60):  # a cloud around one text: some pairs link, others nearly
        w = list(base)
        for _ in range(r.randrange(1, 8)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((200 + i, " ".join(w)))
    rows += [(400 + i, "ka lo mi " + " ".join(r.choice("xyz") for _ in range(r.randrange(5)))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(3)
    sets = [(i, shingle_set(t, words)) for i, t in rows]
    least = {i: i for i, _ in rows}
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and 100 * len(a & b) >= percent * len(a | b)]
    for _ in range(30):
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    got = jaccard.grouped(docs, words, percent, block).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == sorted((i, len(s), least[i]) for i, s in sets)
    assert jaccard.grouped(docs.limit(0)).count() == 0


def shared_ids() -> list[tuple]:
    """Different texts without an id, and under one id; some with a near copy under an id of its own."""
    rows = []
    for i in range(12):
        text = prose(500 + i, 120)
        rows += [(None if i < 6 else 7, text), (50 + i if i % 2 else None, text + " end")]
    return rows


def test_jaccard_of_different_texts_under_one_id(spark):
    rows = shared_ids()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.grouped(docs).collect())
    want = Counter()
    for a, b in zip(rows[::2], rows[1::2], strict=True):
        least = min((i for i, _ in (a, b) if i is not None), default=None)
        want.update((i, len(shingle_set(t, 4)), least) for i, t in (a, b))
    assert got == want
    rows = [(r["row"], 12345) for r in docs.select(jaccard.row_hash().alias("row")).collect()]
    near = jaccard._fetched(docs.withColumn("row", jaccard.row_hash()), spark.createDataFrame(rows, "row long, node long"), 4, {})
    assert near.count() == 0


def cloud(n: int, changes: tuple[int, int], seed: int) -> list[str]:
    """Copies of one text with as many changed words."""
    r = random.Random(seed)
    base = prose(seed, 120).split()
    out = []
    for _ in range(n):
        w = list(base)
        for k in r.sample(range(len(w)), r.randint(*changes)):
            w[k] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def in_components(sets: list, percent: int) -> list[int]:
    least = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if least[i] != least[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = [new if x == old else x for x in least]
    return least


@pytest.mark.parametrize(("words", "percent", "changes"), [(4, 85, (2, 4)), (5, 80, (3, 5))])
def test_jaccard_of_a_cloud_about_the_threshold(spark, words, percent, changes):
    """Hundreds of copies of one text, that link with some others only: no more rows than nodes come from a block."""
    texts = cloud(600, changes, 11)
    want = in_components([shingle_set(t, words) for t in texts], percent)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.grouped(docs, words, percent, block=200).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 1


def test_jaccard_where_hashes_of_sets_clash(spark, docs):
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    texts = docs.select("doc_id", "text").filter("doc_id <> 5")
    want = rows(jaccard.represented(texts, 4, 85).select("doc_id", "n_shingles", "component_id", "kept"))
    assert rows(jaccard.represented(texts, 4, 85, node_bits=3).select("doc_id", "n_shingles", "component_id", "kept")) == want


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 40)]
    least = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert components(spark.createDataFrame([(1, None, 0), (5, 5, 0)], "a long, b long, m int")).count() == 0
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in least.items() if k in got} and all(least[k] == k for k in set(least) - set(got))


def slow_syncmers(raw: bytes, k: int, s: int) -> list[int]:
    out = []
    for i in range(len(raw) - k + 1):
        h = [int(syncmers.window_hashes(np.frombuffer(raw[i + j : i + j + s], np.uint8), (s,))[0][0]) for j in range(k - s + 1)]
        if min(h) in (h[0], h[-1]):
            out.append(i)
    return out


def test_fingerprints(spark, docs):
    raw = prose(3, 40).encode()
    assert syncmers.closed_syncmers(np.frombuffer(raw, np.uint8))[0].tolist() == slow_syncmers(raw, syncmers.K, syncmers.S)
    rows = documents()
    for size in (8 << 20, 500):
        got = syncmers.compared(docs, part_bytes=size).collect()
        order = sorted(rows, key=lambda x: (-x[0], x[1] or ""))
        want = Counter()
        for k, (i, t, _) in enumerate(order):
            t, after = t or "", order[(k + 1) % len(order)][1] or ""
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {r["doc_id"]: r for r in got}
    assert prints[20]["fingerprint"] == prints[5]["fingerprint"] != prints[6]["fingerprint"]
    long = [r for r in got if r["n_chars"] > 600]
    assert np.mean([r["near_edited"] - r["near_next"] for r in long]) > 0.2
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert syncmers.compared(docs.limit(0)).count() == 0 and syncmers.compared(docs.limit(1)).count() == 1
    assert {r["doc_id"]: r["fingerprint"] for r in syncmers.fingerprints(docs).collect()}[20] == prints[20]["fingerprint"]
    assert syncmers.anchors(docs).columns == ["doc_id", "start", "anchor"]


def test_passages_by_anchors(spark):
    passage, other = prose(50, 40), prose(51, 40)
    rows = [(1, prose(1, 30) + " " + passage + " " + prose(2, 30)), (2, passage + passage), (3, prose(3, 80)), (4, None), (None, "é " + passage)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, anchor int")
    asked = spark.createDataFrame([(7, passage), (8, other), (9, None)], "item_id long, text string")
    n = len(passage.encode())
    want = {(7, 1, len(rows[0][1][: rows[0][1].index(passage)].encode())), (7, 2, 0), (7, 2, n), (7, None, 3)}
    assert {(r["item_id"], r["doc_id"], r["start"]) for r in syncmers.located(asked, docs, least=1.0).collect()} == want
    half = spark.createDataFrame([(1, passage[: len(passage) * 2 // 3])], "doc_id long, text string")
    assert [r["start"] for r in syncmers.located(asked, half).collect()] == [0]
    assert syncmers.located(asked, docs.limit(0)).count() == 0


def test_null_ids_and_columns(spark):
    """A null in any column, in every operator."""
    texts = [prose(1, 60), prose(1, 60) + " end", None, prose(2, 60), prose(2, 60)]
    docs = spark.createDataFrame([(None, texts[0], None, 1), (1, texts[1], "s", None), (None, None, None, None), (2, texts[3], "s", 0), (None, texts[4], "s", 0)], "doc_id long, text string, source string, n_chars long")
    n = docs.count()
    assert ngram_lm.scored(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0).count() == n
    assert packing.packed(docs).select("sequence_id").count() >= 1
    assert suffix_dedup.without_repeats(docs).count() == n
    assert pii.found(docs).count() == n and pii.redacted(docs).count() == n
    assert quality.scored(docs, spark.createDataFrame([(None, None), (1, 1), (2, 0)], "doc_id long, quality int")).count() == n
    assert mixing.taken(docs).count() == n
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.grouped(docs).collect()}
    assert got[1, 58] == 1 and got[None, 57] in (1, 2) and got[None, 0] is None and got[2, 57] == 2
    assert syncmers.compared(docs).count() == n
    v = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, None, None)], "vec_id long, embedding array<double>, label int")
    assert sorted((r["n_links"], r["component_id"] or 0) for r in vectors.near_duplicates(v).collect()) == [(0, 0), (1, 1), (1, 1)]
    pages = spark.createDataFrame([(None, None, None), (1, None, "<p>a")], "page_id long, url string, html string")
    assert html_text.extracted(pages).count() == 2


def test_whole_passages_first_place_and_ends(spark):
    """A passage that stands twice is one row; one that differs at an end only is none; brief and empty ones are found."""
    from corpusmill.llm.syncmers import whole_passages

    p = "The quick brown fox jumps over the lazy dog and then rests for a while beside the quiet river."
    passages = spark.createDataFrame([(1, p), (2, "été"), (3, ""), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(10, f"é {p} and again {p}"), (11, f"x {p[:-1]}! x"), (12, f"un été {p}"), (13, None), (None, p)], "doc_id long, text string"
    )
    got = sorted((tuple(r) for r in whole_passages(passages, docs).collect()), key=repr)
    want = [(1, 10, 3), (1, 12, 9), (1, None, 0), (2, 12, 3), *((3, i, 0) for i in (10, 11, 12, None))]
    assert got == sorted(want, key=repr)
