"""Exact dedup, classifier, piece codec, decontamination, URL filter, HTML, records, near duplicates."""

import math
import random
import re
import struct
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from veracel.llm import decontaminate, exact_dedup, html_text, jaccard_join, quality, spiece, token_records, url_filter
from veracel.llm.common import words


# ---- URL filter ----
def naive_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), len(h), p, h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(3)
    hosts = ["net", "example.net", "a.example.net", "EXAMPLE.com", "b.c.example.com", "org", "x.org", "notexample.net", "example.net.", "", "a..net", "net.org", "é.net", "example.net:80"]
    paths = ["", "/", "/en/", "/en/1", "/de/x?q=://y", "/fr/#a", "/enx", "?x", "#f", "/de"]
    urls = [rng.choice(["http://", "https://", "", "x://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(600)] + [None, "", "://", "a://b://c/en/"]
    urls += ["http://hot.example.net/en/"] * 900
    rules = [*url_filter.RULES, ("a.example.net", "/en/1", "block"), ("example.net", "/", "allow"), ("c.example.com", "/", "block"), ("b.c.example.com", "/de/", "allow")]
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(urls)], "page_id long, url string, key string, salt int")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for ranges in (1, 7, 64):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, table, ranges=ranges).collect()}
        assert got == {i: naive_verdict(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, table.limit(0)).collect()} == {"allow"}


# ---- exact dedup ----
@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
def test_exact_groups(spark, odd_docs, keep, pick):
    rows = exact_dedup.duplicate_groups(odd_docs, keep).collect()
    given = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    ids, sizes = {}, Counter(t for _, t in given)
    for d, t in given:
        ids.setdefault(t, []).append(d)
    want = sorted((str(d), str(pick([i for i in ids[t] if i is not None], default=None)), sizes[t]) for d, t in given)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in rows) == want


def test_collisions_are_told_apart(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "ab", "aa", "b", "ab", "ac", "aa"])], "doc_id long, text string")
    weak = lambda t: F.unhex(F.md5(F.substring(t, 1, 1)))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicate_groups(docs, "largest", weak).collect()}
    assert got == {0: (6, 3, False), 2: (6, 3, False), 6: (6, 3, True), 1: (4, 2, False), 4: (4, 2, True), 3: (3, 1, True), 5: (5, 1, True)}


def test_drop_duplicates_keeps_one_row_each(odd_docs, no_docs):
    kept = exact_dedup.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted({(r.text or "") for r in odd_docs.collect()})
    assert exact_dedup.drop_duplicates(no_docs).count() == 0


# ---- classifier ----
def plain_features(text):
    """Bucket to share by the definition, a code point at a time."""
    m64 = (1 << 64) - 1

    def mix(h):
        h = ((h ^ (h >> 33)) * 0xFF51AFD7ED558CCD) & m64
        return h ^ (h >> 29)

    found, words = Counter(), text.split()
    for w in words:
        codes, whole, power = [ord(c) for c in f"<{w}>"], 0, 1
        for c in codes:
            power = power * 0x9E3779B97F4A7C15 & m64
            whole = (whole + mix(c) * power) & m64
        found[mix(whole) % quality.BUCKETS] += 1
        for n in quality.NGRAMS:
            for i in range(len(codes) - n + 1):
                h = n
                for c in codes[i : i + n]:
                    h = mix((h * 0x9E3779B97F4A7C15 + c) & m64)
                found[h % quality.BUCKETS] += 1
    again = sum(a == b for a, b in zip(words, words[1:]))
    if again:
        found[quality.REPEAT] += again
    total = sum(found.values())
    return {b: n / total for b, n in found.items()}


CLASSED = [("clear prose about rivers", 1), ("zz zz zz !!", 0), ("more clear prose, on stones", 1), ("buy buy now", 0), ("a river and its stones", 1), ("été ß 汉字 😀", 1), ("", 0)]


def test_classifier_features_and_scores_equal_a_plain_forward_pass():
    model = quality.train([t for t, _ in CLASSED], [y for _, y in CLASSED], epochs=4)
    texts = [t for t, _ in CLASSED] + ["unseen words here", "river river", "x" * 3000]
    for t, score in zip(texts, model.scorer()(texts)):
        want = plain_features(t)
        buckets, shares = quality.text_features(t)
        assert dict(zip(buckets.tolist(), shares.tolist())) == pytest.approx(want, rel=1e-5)
        z = model.bias + sum(share * float(model.weight[b]) for b, share in want.items())
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_classifier_training_equals_plain_descent():
    """The same starts, order and steps, with a dictionary of vectors and no arrays."""
    texts, labels, epochs, seed = [t for t, _ in CLASSED], [y for _, y in CLASSED], 3, 7
    rng = np.random.default_rng(seed)
    start = (rng.random((quality.BUCKETS, quality.DIM), dtype=np.float32) - 0.5) / quality.DIM
    vectors, layer, bias = {}, [[0.0] * quality.DIM for _ in range(2)], [0.0, 0.0]
    rows = [plain_features(t) for t in texts]
    for r in rows:
        vectors |= {b: start[b].astype(float).tolist() for b in r}
    cost = [len(labels) / (2 * labels.count(c)) for c in (0, 1)]
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            r, y = rows[i], labels[i]
            rate = quality.RATE * (1 - step / steps)
            step += 1
            hidden = [sum(s * vectors[b][d] for b, s in r.items()) for d in range(quality.DIM)]
            z = [sum(a * b for a, b in zip(layer[c], hidden)) + bias[c] for c in (0, 1)]
            e = [math.exp(v - max(z)) for v in z]
            g = [(e[c] / sum(e) - (c == y)) * rate * cost[y] for c in (0, 1)]
            back = [sum(layer[c][d] * g[c] for c in (0, 1)) for d in range(quality.DIM)]
            for c in (0, 1):
                layer[c] = [w - g[c] * h for w, h in zip(layer[c], hidden)]
                bias[c] -= g[c]
            for b, s in r.items():
                vectors[b] = [v - s * len(r) ** 0.5 * k for v, k in zip(vectors[b], back)]
    model = quality.train(texts, labels, epochs, seed)
    toward = [a - b for a, b in zip(layer[1], layer[0])]
    for b, v in vectors.items():
        assert float(model.weight[b]) == pytest.approx(sum(x * t for x, t in zip(v, toward)), abs=2e-4)
    assert model.bias == pytest.approx(bias[1] - bias[0] + math.log(labels.count(1) / labels.count(0)), abs=1e-4)


def test_classifier_learns_and_scores_all(spark, odd_docs, no_docs):
    rng = random.Random(4)
    good, bad = "river stone walked gently morning light".split(), "BUY!! $$$ c1ick xxzz |||".split()
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(400)] + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.score_documents(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    odd = quality.score_documents(odd_docs, model).collect()
    assert len(odd) == 10 and all(0 <= r.score <= 1 for r in odd)
    assert quality.score_documents(no_docs, model).count() == 0
    assert quality.score_documents(docs, quality.fit(docs, labels.limit(0))).where("score <> 0.5").count() == 0


# ---- sentence pieces ----
def test_pieces_equal_the_library(spark, odd_docs, no_docs):
    import sentencepiece

    path = spiece.default_model()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "  a  b ", "abc", "a\nb\n\n c", "é 汉字 😀", "x" * 300, " lead", "trail  ", "1,000.50 % <s> </s> <unk> <0x41>", "\t tab \r\n"]
    got = spiece.Codec(path).encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i, *_ in got] == lib.encode(texts)
    assert all(same and back for _, same, back in got)
    assert spiece.Codec(path).decode([i for i, *_ in got]) == texts
    marked = spiece.Codec(path).encode(["a ▁b c", "plain"])
    assert [r[1:] for r in marked] == [(True, False), (True, True)]  # a marker in the text decodes to a blank
    small = spiece.Codec(path)
    spiece.CACHE_CUTS, kept = 3, spiece.CACHE_CUTS
    try:
        for t in texts * 2:
            assert np.frombuffer(small.encode([t])[0][0], "<u4").tolist() == lib.encode(t)
    finally:
        spiece.CACHE_CUTS = kept
    rows = spiece.round_trips(odd_docs).collect()
    assert len(rows) == 10 and all(r.parity and r.round_trip for r in rows)
    assert spiece.round_trips(no_docs).count() == 0
    assert [*odd_docs.columns] == [c for c in spiece.decode_documents(spiece.encode_documents(odd_docs)).columns if c not in ("parity", "round_trip", "decoded")]


def _message(*given):
    """A protocol buffer message of (number, value): ints, floats, bytes."""
    out = b""

    def varint(v):
        parts = []
        while v > 0x7F:
            parts.append(v & 0x7F | 0x80)
            v >>= 7
        return bytes([*parts, v])

    for number, v in given:
        if isinstance(v, float):
            out += varint(number << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(number << 3) + varint(v)
        else:
            out += varint(number << 3 | 2) + varint(len(v)) + v
    return out


def test_unigram_model_equals_the_library(tmp_path):
    import sentencepiece

    rules = dict(spiece.fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
    charsmap = dict(spiece.fields(rules))[2]
    words_ = ["▁", "▁the", "▁a", "▁cat", "at", "s", "the", "c", "a", "t", "h", "e", "▁th", "b", "1", ".", "ab", "<", ">"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("<sep>", 0.0, 4), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))]
    pieces += [(w, -2.0 - 0.37 * k, 1) for k, w in enumerate(words_)]
    proto = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, kind)))) for p, s, kind in pieces)
    proto += _message((2, _message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2), (43, 2**64 - 1))))
    proto += _message((3, _message((1, b"nmt_nfkc"), (2, charsmap), (3, 1), (4, 1), (5, 1))))
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(proto)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["the cats", "a <s> b", "the<sep>cat", "", "   ", "  the   cat ", "ﬁ ① é 漢 😀", "ＡＢ ab", "tab\tand\nline", "cat cat</s>", "<sep>", "zzz qqq"]
    got = spiece.Codec(path).encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i, *_ in got] == lib.encode(texts)
    assert all(same for _, same, _ in got)
    assert not spiece.Codec(path).encode(["<0x41> x"])[0][1]  # the name of a byte piece, in a text of unknown characters: told, not hidden
    assert [got[0][2], got[5][2]] == [True, False]  # this model trims blanks


# ---- decontamination ----
def naive_hits(text, items, window=10):
    ws = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    hit, seen = set(), set()
    for item, t in items:
        iw = words(t)
        n = min(window, len(iw))
        for k in range(len(iw) - n + 1) if iw else ():
            for i in range(len(ws) - n + 1):
                if ws[i : i + n] == iw[k : k + n]:
                    hit |= set(range(i, i + n))
                    seen.add(item)
    return len(ws), len(hit), seen


def test_automaton_equals_brute_force():
    rng = random.Random(5)
    for trial in range(150):
        vocab = [f"w{i}" for i in range(rng.choice([2, 3, 8]))]
        say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
        items = [(str(i), say(rng.choice([0, 1, 3, 4, 5, 6, 9]))) for i in range(rng.randint(1, 6))]
        auto = decontaminate.Automaton([(i, words(t)) for i, t in items], 4).packed()
        for _ in range(5):
            text = say(rng.randint(0, 40))
            hit, seen = auto.scan(words(text))
            n, n_hit, want = naive_hits(text, items, 4)
            assert (sum(b - a for a, b in hit), seen) == (n_hit, want), (items, text)
            clean, *_ = auto.clean(text)
            assert naive_hits(clean, items, 4)[1] == 0


def test_decontamination_on_odd_rows(spark, odd_docs, no_docs):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, "a text without an id")], "item_id long, text string")
    rows = {(r.doc_id, r.n_words): r for r in decontaminate.hits(odd_docs, bench).collect()}
    assert rows[None, 5].n_hit == 5 and rows[2, 0].n_words == 0 and not rows[8, 1].contaminated
    docs = spark.createDataFrame([(1, f"Before. {item.upper()}, after that more words stay here and are kept as they were", "k"), (2, item, "k"), (3, None, "k")], "doc_id long, text string, __x string")
    kept = {r.doc_id: r.text for r in decontaminate.remove_passages(docs, bench).collect()}
    assert kept == {1: "Before. , after that more words stay here and are kept as they were", 3: None}
    assert decontaminate.hits(no_docs, bench).count() == 0 and decontaminate.hits(odd_docs, bench.limit(0)).where("contaminated").count() == 0


def test_shards_equal_one_automaton(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(3)}" for _ in range(n))
    items = [(i, say(rng.choice([0, 3, 5, 9, 30, 60]))) for i in range(12)]
    bench = spark.createDataFrame([*items, (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(i % 9, say(rng.randint(0, 30)) if i % 7 else None, i) for i in range(60)] + [(90, "not a word of it", 90)], "doc_id long, text string, row long")
    one = sorted(map(repr, decontaminate.hits(docs, bench, 8).collect()))
    assert one == sorted(map(repr, decontaminate.hits(docs, bench, 8, shard_words=20).collect()))
    whole, cut = decontaminate.remove_passages(docs, bench, 8), decontaminate.remove_passages(docs, bench, 8, shard_words=40)
    assert cut.columns == whole.columns == docs.columns
    assert {r.row for r in cut.collect()} == {r.row for r in whole.collect()}
    assert decontaminate.hits(cut, bench, 8).where("contaminated").count() == 0


# ---- pages ----
def test_main_text_by_consensus(spark):
    body = lambda t: f"""<html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>
      <div class="cookie-notice">We use cookies</div><div class=post-12><h1>Head &amp; line</h1><p>{t}<p>Second  &lt;b&gt;<br>line<ul><li>Item</ul></div><aside>Side</aside>
      <form>Sign up<input></form><div id="comments"><p>I disagree with all of this very much indeed</p></div><footer>&copy; 2020</footer></body></html>"""  # noqa: E731
    rows = [(i, f"http://h{i % 2}.example/{i}", body(f"Text number {i} of this page is here.")) for i in range(20)]
    rows += [(90, None, "<p>no host</p>"), (91, "http://h0.example/z", None), (92, "http://h0.example/y", ""), (93, "http://h1.example/w", "<div><p>other page</p></div>"), (0, *rows[0][1:])]
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, host string, winner string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.main_text(pages).collect()]
    assert len(got) == len(rows)
    for i, t, n in got:
        if i < 90:
            assert t == f"Head & line\n\nText number {i} of this page is here.\n\nSecond <b> line\n\nItem" and n == len(t)
    assert {i: t for i, t, _ in got if i >= 90} == {90: "no host", 91: "", 92: "", 93: "other page"}
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_whole_articles_of_nested_layouts(spark):
    part = lambda i, k: f"Paragraph {k} of page {i}, " + "with quite a few more words in it, " * 6
    nested = {
        "article": lambda i: f"<article><h1>Head {i}</h1><p>Intro {i}</p><section><p>{part(i, 1)}</section><ul><li>One</ul><section><p>{part(i, 2)}</section></article>",
        "main": lambda i: f"<main><h1>Head {i}</h1><p>Intro {i}</p><div class=body><p>{part(i, 1)}<ul><li>One</ul><p>{part(i, 2)}</div></main>",
        "div": lambda i: f"<div class=post><h1>Head {i}</h1><p>Intro {i}</p><div class=text><p>{part(i, 1)}</div><ul><li>One</ul><div class=text><p>{part(i, 2)}</div></div>",
    }
    rows = [(len(nested) * i + k, f"http://{host}.example/{i}", f"<body><nav>Home</nav>{page(i)}<footer>Foot</footer></body>") for k, (host, page) in enumerate(nested.items()) for i in range(8)]
    second = f"<body><article><section><p>{part(9, 1)}</section><div class=extra><p>{part(9, 2)}</div></article></body>"
    rows.append((99, "http://article.example/second", second))
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for d, *_ in rows[:-1]:
        i = d // 3
        assert got[d] == "\n\n".join([f"Head {i}", f"Intro {i}", part(i, 1).strip(), "One", part(i, 2).strip()])
    assert got[99] == f"{part(9, 1).strip()}\n\n{part(9, 2).strip()}"


#: Hand-labelled pages: markup, and the blocks that make up the article.
BODY = ("The first paragraph of the article says a good deal about rivers and the stones in them.", "A second one goes on, with more on <b>water</b> and <i>light</i>.")
PLAIN = tuple(re.sub("<.*?>", "", p) for p in BODY)
LABELLED = {
    "class words on the article": (f'<div id="content" class="share-enabled"><h1>Head</h1><p>{BODY[0]}</p><p>{BODY[1]}</p></div><div class="footer">Foot of the page</div>', ["Head", *PLAIN]),
    "search result": (f'<nav><a href=/>Home</a></nav><article class="post search-result"><p>{BODY[0]}<p>{BODY[1]}</article><aside>Side</aside>', [*PLAIN]),
    "headline above the body": (f'<div class="topbar">Site</div><h1>Head</h1><p>Lead in.</p><div class="body"><p>{BODY[0]}</p><p>{BODY[1]}</p></div><p class="legal">All rights reserved</p>', ["Head", "Lead in.", *PLAIN]),
    "marks on other elements": (
        f'<main><h1>Head</h1><p class="advert">Buy now<p>{BODY[0]} <span class="ad">Sponsored by <span>us</span> now</span>Tail.</p><blockquote class="comment"><p>I disagree</p></blockquote>'
        f'<ul><li>One<li class="cookie-notice">We use <b>cookies</b><li>Two</ul><p hidden>Unseen</p><div style="display: none">Nor this</div><p class="related">More<p>{BODY[1]}</main>',
        ["Head", PLAIN[0] + " Tail.", "One", "Two", PLAIN[1]],
    ),
    "quoted and formulas": (f'<article><h1>Head</h1><blockquote>{BODY[0]}</blockquote><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.</p><object data=x>{BODY[1]}</object></article>', ["Head", PLAIN[0], "So x=2.", PLAIN[1]]),
    "page in a form": (f'<form id="aspnetForm"><div class="menu"><a href=1>One</a> <a href=2>Two</a></div><div class=text><p>{BODY[0]}</p><p>{BODY[1]}</p></div></form>', [*PLAIN]),
    "table layout": (f'<table><tr><td class="sidebar"><ul><li>Menu</ul></td><td><h1>Head</h1><p>{BODY[0]}<p>{BODY[1]}</td></tr></table>', ["Head", *PLAIN]),
    "nothing but chrome": ('<nav><a href=/>Home</a></nav><footer>Foot</footer><div class="sidebar">Side of the page</div>', []),
}


def test_labelled_pages(spark):
    rows = [(100 * k + i, f"http://site{k}.example/{i}", f"<html><body>{page}</body></html>") for k, (page, _) in enumerate(LABELLED.values()) for i in range(3)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    right = said = wanted = 0
    for k, (name, (_, want)) in enumerate(LABELLED.items()):
        for i in range(3):
            text = got[100 * k + i]
            blocks = text.split("\n\n") if text else []
            right, said, wanted = right + len(set(blocks) & set(want)), said + len(blocks), wanted + len(want)
            assert blocks == want, name
    print(f"labelled pages: recall {right / wanted:.2f}, precision {right / said:.2f}")


LONGER = "words of the text that say a good deal about rivers and stones."
#: Names that parts of articles have too, and what stays of the page.
NAMES = {
    '<article><h2 id="search-algorithms">Search algorithms</h2><p>{x}</article>': ["Search algorithms", "{x}"],
    '<article><h2 id="related-work">Related work</h2><p>{x}</article>': ["Related work", "{x}"],
    '<article><p>{x}<section id="discussion"><h2>Discussion</h2><p>{x}</section></article>': ["{x}", "Discussion", "{x}"],
    '<article><p>{x}<div class="side-by-side">Left and right</div></article>': ["{x}", "Left and right"],
    '<article><p>{x}<div class="elementor-widget-text">Some</div></article>': ["{x}", "Some"],
    '<article><p>{x}<div class="wp-block-widget">Some</div></article>': ["{x}", "Some"],
    '<main><p class="legal">All of this is law.</main>': ["All of this is law."],
    '<article><p>{x}<div class="related"><a href=1>One more</a> <a href=2>Another</a></div><section class="comments"><p>{x}</section></article>': ["{x}"],
    '<article><h1>Head</h1><p>{x}<aside>Side</aside><div class="search-box"><a href=1>Find</a></div><p>{x}</article>': ["Head", "{x}", "{x}"],
    '<main><div class="toolbar"><a href=1>Print</a></div><h1>Head</h1><div class="legal-text"><p>{x}<p>{x}</div></main>': ["Head", "{x}", "{x}"],
    '<div class="skip"><a href=1>Skip</a></div><div class="post"><h1>Head</h1><p>{x}<p>{x}</div><div class="footer">{x}</div>': ["Head", "{x}", "{x}"],
    '<article class="comments-open"><div class="recommended-reading"><p>{x}</div></article>': ["{x}"],
}


@pytest.mark.parametrize("page", NAMES)
def test_names_alone_drop_no_part_of_an_article(page):
    got = html_text.extract(f"<html><body><nav>Home</nav>{page.format(x=LONGER)}<footer>Foot</footer></body></html>", None)
    assert got == "\n\n".join(NAMES[page]).format(x=LONGER)


def test_broken_pages_do_not_crash():
    for page in ("<", "<a", "<!--", "<script>x", "<p", "a < b > c", "</div></div>", '<a href="x', "<" * 1000, "<div" * 1000 + ">", "&#99999999; &bogus;", "<textarea>", "<![CDATA[x]]>"):
        html_text.extract(page, "body")


# ---- records ----
def test_records_round_trip(spark, odd_docs, no_docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_records.default_tokenizer())
    path = f"file://{tmp_path}/rec"
    index = token_records.encode_to_records(odd_docs, path).orderBy("file", "offset").collect()
    given = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd_docs.collect()))
    start = 0
    for row, (has, d, t) in zip(index, given, strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert (row.doc_id, row.start, row.n_tokens) == (d if has else None, start, len(ids))
        assert row.ids_crc32 == crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    some = spark.createDataFrame([r for r in index if r.doc_id in (4, 8)])
    got = {r.doc_id: r.ids for r in token_records.read_ids(spark, path, some).collect()}
    assert got[8] == [*tok.encode("short").ids, 1] and set(got) == {4, 8}
    kept = spark.read.parquet(f"{path}.index").where("doc_id in (4, 8)")
    through_spark = {r.doc_id: r.ids for r in token_records.read_ids(spark, str(tmp_path / "rec"), kept).collect()}
    assert through_spark == got
    assert token_records.encode_to_records(no_docs, f"file://{tmp_path}/none").count() == 0


def test_damage_is_seen():
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    one = token_records.frame(7, b"\1\0\2\0", 2, pack)
    assert [(d, ids.tolist()) for *_, d, ids in token_records.records(one + one)] == [(7, [1, 2])] * 2
    for k in range(len(one) - 1):
        bad = bytearray(one)
        bad[k] ^= 4
        with pytest.raises(ValueError):
            list(token_records.records(bytes(bad)))


def test_words_encode_as_whole_texts_do():
    enc = token_records.Encoder(token_records.default_tokenizer())
    texts = ["<|endoftext|> A.B. c,,d. e., İ. don't. it's, x'S. ß.́ a.́ \x0b\x0c\x1c z y. q", "", " ", "ABC.\r\nDEF,", "ﬁ. ﬀ, Σ. ΑΣ", "é. É, é", "1.5, 2. a1. 1a.", "a ^ b^ ^^ c|d ~", "a 'll. b's, we'RE."]
    for text, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == [*enc.tok.encode(text, add_special_tokens=False).ids, 1]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    spec = json.loads(Tokenizer.from_file(token_records.default_tokenizer()).to_str())
    assert token_records.by_words(spec)
    assert not token_records.by_words({**spec, "normalizer": None})
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = token_records.Encoder(path)
    assert not enc.cut
    texts = ["Two  words.", "", "A b\n C ^ d"]
    assert [np.frombuffer(i, "<u2").tolist() for i in enc.encode(texts)] == [[*enc.tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_words_of_letters_skip_the_whole_tokenizer(monkeypatch):
    import tokenizers

    class Spy:
        def __init__(self, tok):
            self.tok, self.seen = tok, []

        def __getattr__(self, name):
            return getattr(self.tok, name)

        def encode(self, text, **kw):
            self.seen += text.split()
            return self.tok.encode(text, **kw)

    plain = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", type("Opened", (), {"from_file": staticmethod(lambda path: Spy(plain.from_file(path)))}))
    enc = token_records.Encoder(token_records.default_tokenizer())
    texts = ["Some words, some été, größe. слово 漢字 and&&& more!! words.", "it's 12 É"]
    got = [np.frombuffer(ids, "<u2").tolist() for ids in enc.encode(texts)]
    assert sorted(enc.tok.seen) == sorted([",", ".", "&&&", "!!", "it's", "12", "É"])
    assert got == [[*enc.tok.tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_letters_and_marks_encode_as_the_tokenizer_does():
    import random
    import re

    enc, r = token_records.Encoder(token_records.default_tokenizer()), random.Random(3)
    letters = [c for c in map(chr, range(0x10000)) if re.fullmatch(f"[{token_records.LETTERS}]", c)]
    assert all(token_records.LETTERS_THEN_MARKS.fullmatch(c) and enc.tok.normalizer.normalize_str(c + c) == c + c for c in letters)
    some = [*letters[:400], *"abcstvremdl" * 20, *"'.,!#$<|>&-_`~\"" * 3, *"019 \t\x0b\x1c\x85\xa0", *"\u0301\u0323\u1161\u11a8ÉİΣ²ſﬁ"]
    texts = [*letters, *("".join(r.choices(some, k=r.randint(1, 25))) for _ in range(5000)), "a<|endoftext|>. <|endoftext|>.", "é" * 1000 + ". " + "漢" * 1000 + "!! it's" + "x" * 1000 + "."]
    for text, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == [*enc.tok.encode(text, add_special_tokens=False).ids, 1], text


def test_cuts_of_another_tokenizer_are_its_own(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(Tokenizer.from_file(token_records.default_tokenizer()).to_str())
    assert token_records.by_letters(spec)
    at_blanks = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][1]]}
    steps = spec["normalizer"]["normalizers"]
    added = [*spec["added_tokens"], {**spec["added_tokens"][0], "id": spec["added_tokens"][-1]["id"] + 1, "content": "ord"}]
    others = [{"pre_tokenizer": at_blanks}, {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFD"}, *steps[1:]]}}, {"added_tokens": added}]
    for k, other in enumerate(others):
        assert not token_records.by_letters(spec | other)
        (tmp_path / f"{k}.json").write_text(json.dumps(spec | other))
        enc = token_records.Encoder(str(tmp_path / f"{k}.json"))
        texts = ["Words, word. été. größe!! it's.", "한글 ord"]
        assert [np.frombuffer(i, "<u2").tolist() for i in enc.encode(texts)] == [[*enc.tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]


# ---- near duplicates ----
def naive_links(rows, n=5, threshold=0.8):
    sets = {d: frozenset(tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))) if (ws := words(t)) else frozenset() for d, t in rows}
    link = {(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or (sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])))}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in sorted(link):
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    return link, {d: find(d) for d in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(400)]
    rows, d = [], 0
    for size in (1, 2, 3, 8, 40):
        for _ in range(4):
            base = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
            for _ in range(size):
                ws = list(base)
                for _ in range(rng.randint(0, 3)):
                    ws[rng.randrange(len(ws))] = rng.choice(vocab)
                rows.append((d, " ".join(ws)))
                d += 1
    rows += [(d, rows[0][1]), (d + 1, rows[0][1].upper()), (d + 2, None), (d + 3, ""), (d + 4, "two words"), (d + 5, "Two, words!")]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, copy string, id int")
    link, classes = naive_links(rows)
    for how in ({}, {"block": 8}, {"exact": True, "block_bytes": 4096}):
        got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs, **how).collect()}
        assert {i: r.class_id for i, r in got.items()} == classes
        degree = Counter(x for pair in link for x in pair)
        assert {i: r.n_linked_docs for i, r in got.items()} == {i: degree[i] for i in got}
    kept = jaccard_join.keep_one(docs)
    assert {r.doc_id for r in kept.collect()} == set(classes.values()) and kept.columns == docs.columns


def test_near_duplicates_on_odd_rows(odd_docs, no_docs):
    got = jaccard_join.near_duplicates(odd_docs)
    got = sorted((str(r.doc_id), r.class_id, r.rep_id, r.n_links, r.n_linked_docs) for r in got.collect())
    alone = [("7", 7, 7, 0, 0), ("8", 8, 8, 0, 0), ("None", None, None, 0, 0)]
    assert got == [("1", 1, 1, 0, 1)] * 2 + [(d, 2, 2, 0, 2) for d in "236"[:2]] + [("4", 4, 4, 0, 1), ("5", 4, 4, 0, 1), ("6", 2, 2, 0, 2), *alone]
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_ids_do_not_tell_texts_apart(spark):
    own, near, other = ([f"{w}{i}" for i in range(60)] for w in "abc")
    say = lambda ws, *more: " ".join([*ws, *more])
    rows = [(-1, say(own)), (None, say(own, "x")), (None, say(near)), (None, say(near, "y")), (-1, say(other)), (5, say(own, "z")), (9, say(near, "z"))]
    docs = spark.createDataFrame([(*r, i, "k") for i, r in enumerate(rows)], "doc_id long, text string, kept long, count string")
    got = jaccard_join.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.class_id, r.n_links) for r in got) == sorted(
        [("-1", -1, 2), ("None", -1, 2), ("5", -1, 2), ("-1", -1, 0), ("None", 9, 2), ("None", 9, 2), ("9", 9, 2)]
    )
    assert len({r.class_key for r in got}) == 3
    assert sorted(r.kept for r in jaccard_join.keep_one(docs).collect()) == [0, 4, 6]


def test_prefix_depth_meets_the_recall():
    d = jaccard_join.prefix_depth()
    assert jaccard_join.recall_at(d) >= jaccard_join.RECALL > jaccard_join.recall_at(d + 1)


def test_paths_end_where_the_estimate_is_met():
    rng = np.random.default_rng(3)
    trees, floor = jaccard_join.TREES, jaccard_join.prefix_depth() - jaccard_join.SLACK
    perms = jaccard_join._permutations(trees * jaccard_join.DEPTH)
    how = (perms, trees, jaccard_join.THRESHOLD, jaccard_join.RECALL, floor)
    for n, keep, more in ((45, 40, 5), (50, 40, 0), (40, 40, 10), (4, 4, 1)):  # pairs at the threshold
        one = [rng.integers(0, 1 << 63, n + more, np.uint64) for _ in range(1500)]
        two = [np.sort(np.concatenate([s[:n][rng.permutation(n)[:keep]], s[n:]])) for s in one]
        one = [np.sort(s[:n]) for s in one]
        met = [
            any(x[min(len(x), len(y)) - 1] == y[min(len(x), len(y)) - 1] for x, y in zip(a, b))
            for a, b in zip(jaccard_join.paths(one, *how), jaccard_join.paths(two, *how))
        ]
        assert np.mean(met) >= 0.999
    sets = [np.sort(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 3, 5, 20, 20, 300, 9000)]
    signed = [jaccard_join.signature(s, perms) for s in sets]
    for s, (least, who) in zip(sets, signed):  # against one minimum at a time
        for t in range(0, len(least), 17):
            h = s * perms[0][t] + perms[1][t]
            h ^= h >> np.uint64(31)
            assert (least[t], who[t]) == (h.min(), s[h.argmin()])
    least, who = (np.stack(x).reshape(len(sets), trees, -1) for x in zip(*signed))
    chance = jaccard_join.chances(np.array([len(s) for s in sets]), least, who, jaccard_join.THRESHOLD)
    ends = jaccard_join.stops(chance, jaccard_join.RECALL, floor)
    assert (ends[:2] == jaccard_join.DEPTH).all()  # three n-grams or fewer: only copies are as similar
    for k, e in enumerate(ends):
        missed = [np.prod([1 - chance[c, k, t, d - 1] for t, d in enumerate(e)]) for c in range(3)]
        assert max(missed) <= 1 - jaccard_join.RECALL + 1e-9 or (e == floor).all()


def test_copy_groups_do_not_hide_pairs_at_the_threshold(spark):
    rng = random.Random(8)
    say = lambda k: [f"{rng.getrandbits(40):x}" for _ in range(k)]
    rows = []
    for _ in range(600):  # 40 of 50 n-grams in common
        base = say(44)
        rows += [(len(rows), " ".join(base + say(5))), (len(rows) + 1, " ".join(base + say(5)))]
    group = say(300)
    copies = [(len(rows) + i, " ".join(group + say(1))) for i in range(300)]
    got = {r.doc_id: r.class_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows + copies, "doc_id long, text string")).collect()}
    assert [d for d, _ in rows if got[d] != d - d % 2] == []
    assert {got[d] for d, _ in copies} == {len(rows)}


def test_repeated_and_null_ids(spark):
    own, copy, near = ("".join(f"{w}{i} " for i in range(60)) for w in "abc")
    rows = [(1, own), (1, copy), (2, copy), (None, near), (None, near), (None, near + "more"), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    exact = exact_dedup.drop_duplicates(docs)
    assert sorted((str(r.doc_id), r.text or "") for r in exact.collect()) == sorted([("1", own), ("2", copy), ("None", near), ("None", near + "more"), ("3", "")])
    kept = sorted((str(r.doc_id), (r.text or "")[:180]) for r in jaccard_join.keep_one(docs).collect())
    assert kept == sorted([("1", own[:180]), ("1", copy[:180]), ("None", near[:180]), ("3", "")])
