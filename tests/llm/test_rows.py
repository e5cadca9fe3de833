"""Operators that judge rows alone: quality, tokenizer, edit counts, main text, URLs."""

import hashlib
import random
import re
import struct
import subprocess
import sys
from collections import Counter

import pytest
import zstandard
from tokenizers import Tokenizer

from lexmill.llm import bpe, edits, html, quality, tokenizer, urls

ODD = [None, "", "   \n\t", "a", "é日本🙂 \x1c\u00a0 x", "word " * 40000, "x" * 70000, "a b c d a b c d", "same line\nsame line\n\nsame line", "# * $ % & | < >", "I'll <|endoftext|> can't\r\n\r\n  end "]
PATH = tokenizer.tokenizer_path(tokenizer.TOKENIZER)


def docs(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, "twice"), (7, "twice")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def table_texts(spark):
    return [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def brute_quality(i, text):
    text = text or ""
    words = re.findall("[^ \t-\r]+", text)
    threes = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if threes[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
    failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
    raw, packer = text.encode(), zstandard.ZstdCompressor(level=quality.LEVEL)

    def band(n):
        return next(((a, b) for s, a, b in reversed(quality.TEXT_BANDS) if n >= s), (0, 9e9))

    ratio = len(packer.compress(raw)) / len(raw) if raw else 0.0
    ok = not raw or band(len(raw))[0] <= ratio <= band(len(raw))[1]
    parts = [raw[k : k + quality.CHUNK] for k in range(0, len(raw), quality.CHUNK)] if len(raw) > quality.CHUNK else []
    for side in (0, 1):
        bad = 0
        for p in parts:
            r, limits = len(packer.compress(p)) / len(p), quality.CHUNK_BAND if len(p) == quality.CHUNK else band(len(p))
            bad += r < limits[0] if side == 0 else r > limits[1]
        ok = ok and bad <= quality.BAD_CHUNKS * len(parts)
    return (i, *base, failed, ok and not failed)


def test_quality(spark):
    rng = random.Random(1)
    junk = ["".join(rng.choice("0123456789abcdef") for _ in range(9000)) + " w" * 60, " ".join(f"{rng.random():.17f}" for _ in range(900)), " ".join(f"w{i}" for i in range(3000))]
    frame, rows = docs(spark, ODD + junk + table_texts(spark))
    got = [tuple(r)[:8] for r in quality.judge(frame).collect()]
    assert sorted(got, key=str) == sorted((brute_quality(*r) for r in rows), key=str)
    kept = quality.keep_good(frame.selectExpr("text", "doc_id", "1 as kept", "text as ratio"))
    assert kept.columns == ["text", "doc_id", "kept", "ratio"] and kept.count() == sum(r[7] for r in got)
    assert quality.judge(frame.limit(0)).count() == 0


def test_bands_reject_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.judge(docs).filter("not base_failed").join(labels, "doc_id").collect()
    out = [r.quality for r in judged if not r.kept]
    assert len(out) >= 10 and out.count(0) >= 0.9 * len(out)
    good = [r.kept for r in judged if r.quality]
    assert sum(good) >= 0.98 * len(good)
    # limits fitted on this small sample lie near those of the large one
    text, chunk = quality.fit_bands(docs, labels)
    assert [b[0] for b in text] == [b[0] for b in quality.TEXT_BANDS] and all(abs(a[1] - b[1]) < 0.05 for a, b in zip(text, quality.TEXT_BANDS, strict=True)) and abs(chunk[0] - quality.CHUNK_BAND[0]) < 0.05


def test_encoded_documents_are_incompressible():
    import base64

    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    for size in (500, 900, 3000, 5000, 9000, 15000, 40000):
        raw = base64.encodebytes(random.Random(size).randbytes(size))
        assert quality.compression(raw, packer)[3] == "incompressible", size


def test_tokenizer(spark):
    t = Tokenizer.from_file(PATH)
    frame, rows = docs(spark, ODD + table_texts(spark))

    def want(i, text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    got = tokenizer.round_trip(frame.selectExpr("*", "'x' as ids"))
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == sorted((want(*r) for r in rows), key=str)
    assert all(r.decoded == r.text for r in tokenizer.decode(got.select("doc_id", "ids").filter("doc_id <> 7").join(frame.dropDuplicates(["doc_id"]), "doc_id").fillna("")).collect())
    assert tokenizer.round_trip(frame.limit(0)).count() == 0


def test_memory_of_many_words():
    code = """
import random, resource
from lexmill.llm import bpe, tokenizer
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
coder, rng = bpe.automaton(tokenizer.tokenizer_path(tokenizer.TOKENIZER)), random.Random(1)
before = peak()
for _ in range(4):
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(250)) for _ in range(1000)]
    list(coder.encode_all(texts))
print((peak() - before) // 1024)
"""
    grown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120)
    assert int(grown.stdout) < 180  # MB, for a million different words; the automaton itself is not counted


def test_automaton_on_random_words():
    t, a, rng = Tokenizer.from_file(PATH), bpe.automaton(PATH), random.Random(2)
    for _ in range(3000):
        word = "".join(rng.choice("abcdething éß日🙂 '-\n") for _ in range(rng.randint(0, 40)))
        ids = t.encode(word, add_special_tokens=False).ids
        assert a.encode(word) == struct.pack(f"<{len(ids)}I", *ids) and a.decode(a.encode(word)) == t.decode(ids, skip_special_tokens=False)


def test_edit_counts(spark):
    t, rng = Tokenizer.from_file(PATH), random.Random(3)
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    coder = bpe.automaton(PATH)
    for _ in range(300):
        marks = [*"ab cd'll  \n1.é🙂", "<|endoftext|>", "<|endo", "ftext|>"]
        text = "".join(rng.choice(marks) for _ in range(rng.choice([0, 1, 30, 2000])))
        tree = edits.CountTree(text, coder)
        for _ in range(8):
            start, size, new = rng.randint(0, len(text) + 2), rng.choice([0, 1, 5, 300]), "".join(rng.choice([*"ab '\n7", "<|", "|>", "<|endoftext|>"]) for _ in range(rng.choice([0, 1, 9, 700])))
            cut = min(start, len(text))
            text = text[:cut] + new + text[max(cut, min(len(text), start + size)) :]
            tree.edit(start, size, new)
            assert tree.text == text and tree.total == count(text)
    rows = [(1, "one two", [(3, 1, "-"), None, (99, 5, None)]), (2, None, [(0, 3, "new text")]), (None, "x", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,length:long,new:string>>")
    got = {r.doc_id: r for r in edits.count_edited(frame).collect()}
    assert got[1].n_after == count("one-two") and got[1].n_edits == 2 and got[2].n_after == count("new text") and got[None].n_before == 1
    assert edits.count_edited(frame.limit(0)).count() == 0
    long = [(1, "word and more, " * 200_000, [(2_000_000, 7, "<|endoftext|>"), (0, 1, "x")]), (5, "same", [(4, 0, "s")]), (5, "same", [(4, 0, "s")])]
    held = spark.createDataFrame(long, "doc_id long, text string, edits array<struct<start:long,length:long,new:string>>").selectExpr("*", "'x' as n_after", "1 as after")
    got = sorted((r.doc_id, r.n_after, r.chars_encoded < 1000) for r in edits.count_edited(held).collect())
    edited = "x" + (long[0][1][:2_000_000] + "<|endoftext|>" + long[0][1][2_000_007:])[1:]
    assert got == [(1, count(edited), True), (5, count("sames"), True), (5, count("sames"), True)]


def test_trees_encode_new_words_at_once(monkeypatch):
    t, coder = Tokenizer.from_file(PATH), bpe.automaton(PATH)
    texts = ["", *(x or "" for x in ODD), *(f"fresh{k} wörd{k}'ll <|endoftext|> {k}" for k in range(500))]
    coder.words.clear()
    coder.words.older = {}
    with monkeypatch.context() as m:
        m.setattr(coder, "encode_one", None)  # no word is encoded alone
        built = list(edits.trees(texts, coder))
    assert [x.text for x in built] == texts
    assert [x.total for x in built] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert [x.words for x in built] == [edits.CountTree(x, coder).words for x in texts]


PAGES = {
    "plain": ("<html><body><nav><a>Home, page</a></nav><article><h1>T</h1><p>One, two.<p>Three &amp; four<br>five</article><footer>Foot, note.</footer>", "T\nOne, two.\nThree & four five"),
    "divs": ('<div id="top-nav">Menu one, two.</div><div class="w"><div class="content"><h2>Head</h2><p>A long, long sentence; with text.</p><ul><li>x<li>y</ul><div class="ad-box">Buy, now!</div></div><div class="sidebar">Side, bar. Really.</div></div><div id="comments"><p>Nice, post! So good, yes.</p></div>', "Head\nA long, long sentence; with text.\nx\ny"),
    "main": ("<header>Site</header><main><section><h1>Title</h1><p>Text here, and more.</p></section><form>Send, it</form><aside>By the way, hm.</aside></main><script>if (a<b) '</p>'</script>", "Title\nText here, and more."),
    "torn": ('<p>First, line.</p><p>second <b>bold</b> 3 < 4 &lt;x&gt;</p><p>cut <a href="x', "First, line.\nsecond bold 3 < 4 <x>\ncut"),
    "none": ("<html><nav>a</nav><script>x</script></html>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    assert html.main_text(PAGES[name][0]) == PAGES[name][1]


LONG = "A long sentence, with some words; and more of them. " * 8
WHOLE = LONG.strip()
WRAPPED = {
    "article classes": (f'<nav>Menu</nav><article class="post category-social tag-search"><h1>T</h1><p>{LONG}</p></article>', f"T\n{WHOLE}"),
    "wrap": (f'<div class="content-sidebar-wrap"><h1>T</h1><p>{LONG}</p></div><div class="sidebar">Side, bar.</div>', f"T\n{WHOLE}"),
    "no sidebar": (f'<body><div class="no-sidebar"><article><p>{LONG}</p></article></div></body>', WHOLE),
    "form page": (f'<body><form action="x.aspx"><div><p>{LONG}</p><p>{LONG}</p></div></form></body>', f"{WHOLE}\n{WHOLE}"),
    "sections": (f'<article><p>{LONG}</p><h2 id="related-work">Related work</h2><p>{LONG}</p><section id="search"><p>{LONG}</p></section><div class="share"><a href="x">Share, now!</a></div></article>', f"{WHOLE}\nRelated work\n{WHOLE}\n{WHOLE}"),
}
SPREAD = {
    "page": (f"<div id=page><h1>Title</h1><p>lead</p><div class=text>{LONG * 9}</div><p>end</p></div>", f"Title\nlead\n{(LONG * 9).strip()}\nend"),
    "pre": (f"<body><p>Short intro.</p><pre>{LONG * 9}</pre></body>", f"Short intro.\n{(LONG * 9).strip()}"),
    "articles": (f"<body><p>Site</p><article><p>{LONG * 10}</p></article><article><p>{LONG}</p></article></body>", f"{(LONG * 10).strip()}\n{WHOLE}"),
}


KEPT = {
    "result class": (f'<body><div class="search-result article"><p>{LONG}</p></div></body>', WHOLE),
    "has sidebar": (f'<body><div class="has-sidebar wrap"><div class="post"><h1>T</h1><p>{LONG}</p></div></div></body>', f"T\n{WHOLE}"),
    "notice": (f'<article><p>{LONG}</p><blockquote class="notice">{LONG}</blockquote><p>End.</p></article>', f"{WHOLE}\n{WHOLE}\nEnd."),
    "math": (f"<article><p>{LONG} Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold<script>a()</script>, and <noscript>so</noscript> on.</p></article>", f"{WHOLE} Let x=1 hold, and so on."),
    "links": (f'<div id="a"><p>{LONG}</p><p>See <a href="x">this page, that page</a> also.</p></div>', f"{WHOLE}\nSee this page, that page also."),
}


@pytest.mark.parametrize("name", KEPT)
def test_article_text_is_kept(name):
    assert html.main_text(KEPT[name][0]) == KEPT[name][1]


SCORED = f'<body><div id="x"><div class="promo">Buy now, and save!</div><p>{LONG}</p><div class="sidebar">Side, bar.</div><p>{LONG}</p><ul class="toc"><li><a href="1">One</a><li><a href="2">Two</a></ul></div><div>Site title</div></body>'


def test_scores_select_the_text(monkeypatch):
    assert html.main_text(SCORED) == f"{WHOLE}\n{WHOLE}"
    scores = html.path_scores
    with monkeypatch.context() as m:
        m.setattr(html, "path_scores", lambda runs: dict.fromkeys(scores(runs), 1.0))
        assert html.main_text(SCORED) != f"{WHOLE}\n{WHOLE}"
    with monkeypatch.context() as m:
        m.setattr(html, "THRESHOLD", 0.0)
        m.setattr(html, "WEAK", 0.0)
        assert html.main_text(SCORED) != f"{WHOLE}\n{WHOLE}"


@pytest.mark.parametrize("name", WRAPPED)
def test_words_of_classes_alone_drop_nothing(name):
    assert html.main_text(WRAPPED[name][0]) == WRAPPED[name][1]


@pytest.mark.parametrize("name", SPREAD)
def test_all_parts_of_the_content(name):
    assert html.main_text(SPREAD[name][0]) == SPREAD[name][1]


def test_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    frame = spark.createDataFrame([(r.page_id, r.url, r.html) for r in rows] + [(None, None, None), (1, "u", "")], "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    from html import unescape

    want = {}
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        lines = [" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want[r.url] = "\n".join(x for x in lines if x)
    assert html.extract(frame.limit(0)).count() == 0 and html.extract(frame.union(frame)).count() == 2 * len(rows) + 4
    got = html.extract(frame).collect()
    assert len(got) == len(rows) + 2 and all(r.text == want.get(r.url, "") and r.n_chars == len(r.text) for r in got)
    assert html.main_text("<div>" * 3000 + "deep, text." + "</div>" * 10) == "deep, text." and html.main_text("<" * 2000 + "a" * 3000)


def brute_url(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, rules in (("block", urls.BLOCK), ("allow", urls.ALLOW)) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    odd = [None, "", "no scheme/com/en/", "http://", "HTTP://A.COM/en/x", "http://com/en/", "http://xcom/en/", "http://a.example.com/en/7?x#y", "http://example.com/en/8", "http://a.net/de/8", "http://example.net/de/80", "http://b.org?x/es/", "http://b.org/es/#", "x://a://b/c", "http://É.org/es/é", "http://q.com/" + "z" * 50000]
    known = [r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rows = list(enumerate(odd + known)) + [(None, "http://a.b"), (3, "http://a.b"), (3, "http://a.b")]
    frame = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "1 as verdict")
    held_out = {w for w in urls.BAD_WORDS[14:] + urls.GOOD_WORDS[14:]}
    table = urls.labelled_urls()
    assert len(table) <= urls.MAX_LABELLED
    seen = [r for r in table if not any(w in r[0] for w in held_out)]
    weights, bias = urls.fit(spark.createDataFrame(seen, "url string, label int"))
    got = urls.judge(frame, weights, bias).collect()
    by = Counter((r.page_id, r.host, r.path, r.rule) for r in got)
    assert by == Counter((i, *brute_url(u)[:3]) for i, u in rows)
    assert all(r.verdict == (brute_url(dict((str(i), u) for i, u in rows)[str(r.page_id)])[3] or ("block" if r.score > 0.5 else "allow")) for r in got)
    rest = [r for r in table if r not in seen]
    judged = urls.judge(spark.createDataFrame([(u, u) for u, _ in rest], "page_id string, url string"), weights, bias).collect()
    right = sum((r.score > 0.5) == bool(dict(rest)[r.page_id]) for r in judged)
    assert right / len(rest) >= 0.6
    own = urls.judge(spark.createDataFrame([(u, u) for u, _ in seen], "page_id string, url string"), weights, bias).collect()
    assert sum((r.score > 0.5) == bool(dict(seen)[r.page_id]) for r in own) / len(seen) > 0.98
    assert urls.judge(frame.limit(0), weights, bias).count() == 0
