"""Search, archives, pages and the pipeline."""

import base64
import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import html_extract, html_pages, shared, topk, warc


@pytest.mark.parametrize("block", [64, 8192])
def test_search_against_brute_force(spark, block):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(30)]  # ties
    rows += [(50, rows[7][1])]  # a repeated id
    odd = [(2000, None), (2100, []), (2200, [float("nan")] * 8), (2300, [float("inf")] + [0.0] * 7), (2400, [None] * 8), (2500, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for x in topk.search_index(topk.index(df, block=block), df.where("vec_id % 100 = 0 AND vec_id != 50"), 10).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    vectors = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    for q, v in vectors:
        if q % 100 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q)[:10]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert not {2000, 2100, 2200, 2300, 2400} & set(got)
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:4], df.select("vec_id", "embedding").schema)
    assert topk.search(few, few.where("vec_id = 0")).count() == 3


def test_processing_stops_on_proof():
    """The best are exact, and the proof ends most searches before all postings are processed."""
    r = np.random.default_rng(9)
    m = np.floor(1024 * r.normal(size=(4000, 64)) / 8).astype(np.int64)
    m[:300] = m[0] + r.integers(-20, 20, (300, 64))  # a group of copies
    block = topk.Block.of_row(topk.Block(np.arange(4000), m).to_row())
    shares = []
    for own in [0, 5, *range(400, 430)]:
        ids, scores, share = block.search(m[own], 10, None, own)
        exact = m @ m[own]
        exact[own] = -(1 << 60)
        best = np.lexsort((np.arange(4000), -exact))[:10]
        assert (exact[ids] == scores).all() and set(best) <= set(ids)
        shares.append(share)
    assert max(shares) < 0.9 and np.mean(shares) < 0.75


def _pages(spark, n=120):
    r = random.Random(2)
    rows = [(i, f"http://x.example/{i}", f"<p>{i % 40}" + "é" * r.randint(0, 50)) for i in range(n)]
    rows += [(n, None, None), (n + 1, "u", ""), (n + 2, "a b\nc", "x" * 300_000), (n + 3, "u", "x" * 300_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit("clash"))


def test_archive_round_trip(spark):
    rows, df = _pages(spark)
    root = shared.place(spark, "warc")
    manifest = warc.write(df, root, roll=1000)
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    got = {r.page_id: r for r in warc.read(spark, root, manifest, payloads=True).collect()}
    assert len(got) == len(rows) and manifest.count() > 3
    for i, _, h in rows:
        raw = (h or "").encode()
        refers = None if first[h or ""] == i else first[h or ""]
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.refers_to, r.record_type) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), refers, "response" if refers is None else "revisit")
        assert bytes(r.payload) == (raw if refers is None else b"")


def test_archives_follow_from_pages_alone(spark):
    _, df = _pages(spark)
    listed = []
    for n in (1, 7):
        root = shared.place(spark, "warc")
        listed.append(sorted(map(tuple, warc.write(df.repartition(n), root, roll=1000).collect())))
    assert listed[0] == listed[1]
    ids = [(m[4], m[5]) for m in listed[0]]
    assert all(a[1] < b[0] for a, b in zip(ids, ids[1:], strict=False))  # ranges in order


def test_first_pages_of_ranges_in_any_order():
    batch = pa.RecordBatch.from_arrays([pa.array([50, 60, 10, 20]), pa.array([0, 5, 0, 5]), pa.array([1, 1, 0, 0], pa.int32())], names=["page_id", "begin", "part"])
    (got,) = warc._firsts([batch], np.array([0, 10]), 12)
    assert got.to_pylist() == [{"file": 0, "page_id": 10}, {"file": 1, "page_id": 60}]


def test_revisits_can_be_resolved_by_any_reader(spark):
    """Plain reading, file by file: a warcinfo first, and every revisit names a response's target, date and page."""
    rows = [(5, "http://a.example/5", "same"), (6, "http://a.example/6", "same"), (6, "http://a.example/6b", "other"), (6, "http://a.example/6", "same"), (7, None, "same"), (8, " ", "own"), (5, "http://a.example/5b", "same")]
    root = shared.place(spark, "warc")
    manifest = warc.write(spark.createDataFrame(rows * 1, "page_id long, url string, html string"), root, roll=400)
    responses, revisits, infos = {}, [], 0
    for m in manifest.collect():
        with open(root.removeprefix("file://") + "/" + m.name, "rb") as f:
            kinds = []
            for member in warc.members(f):
                h = warc.parse(member)["headers"]
                kinds.append(h["WARC-Type"])
                if kinds[-1] == "response":
                    responses[h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Payload-Digest"]] = h
                elif kinds[-1] == "revisit":
                    revisits.append(h)
            infos += kinds[0] == "warcinfo" and kinds.count("warcinfo") == 1
    assert infos == manifest.count() > 1 and len(revisits) == 3
    for h in revisits:
        assert responses[h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"], h["WARC-Payload-Digest"]]["WARC-Page-ID"] == h["WARC-Refers-To-Page"] == "5"
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, root).collect())
    assert got == {(5, "response", None): 2, (6, "revisit", 5): 2, (6, "response", None): 1, (7, "revisit", 5): 1, (8, "response", None): 1}


def test_damage_is_noticed(spark):
    _, df = _pages(spark, 5)
    root = shared.place(spark, "warc")
    manifest = warc.write(df, root)
    name = manifest.first()["name"]
    path = root.removeprefix("file://") + "/" + name
    data = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(data[: len(data) // 2])
    with pytest.raises(Exception):  # noqa: B017, PT011
        warc.read(spark, root, manifest).collect()


def test_pages_need_an_id(spark):
    df = spark.createDataFrame([(None, "u", "x")], "page_id long, url string, html string")
    with pytest.raises(Exception, match="without a page_id"):
        warc.write(df, shared.place(spark, "warc"))


def test_empty_archive(spark):
    _, df = _pages(spark, 1)
    root = shared.place(spark, "warc")
    assert warc.read(spark, root, warc.write(df.limit(0), root)).count() == 0


def test_extraction_of_generated_layouts():
    """Pages of the trainer's own writer that it has not seen."""
    trained = html_extract.model()
    exact = words = hit = told = 0
    for i in range(120):
        html, want = html_pages.make(77, i)
        (got,) = html_extract.extract_batch([html.replace(html_pages.MARK, "")], trained)
        exact += got.split() == want.split()
        a, b = Counter(want.split()), Counter(got.split())
        words, hit, told = words + a.total(), hit + (a & b).total(), told + b.total()
    assert exact / 120 > 0.8 and hit / words > 0.97 and hit / told > 0.97


#: Pages written by hand, by no generator, with their main text.
WRITTEN = [
    (
        """<!DOCTYPE html>
<html lang="en"><head><title>River levels rise - The Valley Herald</title><link rel="stylesheet" href="/s.css"></head>
<body class="home single">
<a class="skip-link" href="#content">Skip to content</a>
<header class="masthead"><div class="logo"><a href="/">The Valley Herald</a></div>
<nav class="topnav"><ul><li><a href="/local">Local</a></li><li><a href="/sport">Sport</a></li><li><a href="/weather">Weather</a></li></ul></nav></header>
<main id="content"><article class="story">
<h1>River levels rise after a week of rain</h1>
<p>The river rose by almost a metre on Tuesday, the council said, and two footbridges in the lower town were closed to walkers until the weekend.</p>
<p>Farmers along the east bank moved cattle to higher ground. &ldquo;We have seen worse,&rdquo; said one of them, who has kept a diary of the water since 1981.</p>
<h2>More rain on the way</h2>
<p>Forecasters expect another wet spell from Friday. The pumps at the old mill have been <a href="/pumps">serviced</a> and are ready.</p>
</article>
<aside class="related-stories"><h3>Related</h3><ul><li><a href="/a">Mill pumps pass inspection</a></li><li><a href="/b">Bridge repairs delayed again</a></li></ul></aside></main>
<footer class="site-footer"><p>Copyright 2021 Valley Media. All rights reserved.</p><ul><li><a href="/about">About</a></li><li><a href="/privacy">Privacy</a></li></ul></footer>
</body></html>""",
        "River levels rise after a week of rain\nThe river rose by almost a metre on Tuesday, the council said, and two footbridges in the lower town were closed to walkers until the weekend.\nFarmers along the east bank moved cattle to higher ground. “We have seen worse,” said one of them, who has kept a diary of the water since 1981.\nMore rain on the way\nForecasters expect another wet spell from Friday. The pumps at the old mill have been serviced and are ready.",
    ),
    (
        """<html><body><div id="wrap"><div id="menu"><a href="/">home</a> | <a href="/archive">archive</a> | <a href="/contact">contact</a></div>
<div class="post"><h2 class="title">Fixing the garden gate</h2>
<p>The hinge had rusted through, so I took the gate down and cleaned the post with a wire brush before fitting a new one.
<p>It took most of the afternoon, largely because the old screws would not move at all.
<p>Two coats of paint later it looks as good as new.
</div><div class="comments" id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b> says: <p>Lovely work, mine needs doing too.</p></div><div class="comment"><b>Jo</b> says: <p>Which paint did you use?</p></div></div>
<div id="sidebar"><h4>Recent posts</h4><ul><li><a href="/1">Pruning roses</a><li><a href="/2">A shed of one's own</a></ul></div>
<div id="footer">Powered by patience. <a href="/feed">Feed</a></div></div></body></html>""",
        "Fixing the garden gate\nThe hinge had rusted through, so I took the gate down and cleaned the post with a wire brush before fitting a new one.\nIt took most of the afternoon, largely because the old screws would not move at all.\nTwo coats of paint later it looks as good as new.",
    ),
    (
        """<!doctype html><html><head><title>sort</title><script>if (a < b && c > d) { document.write("<p>no</p>"); }</script></head><body>
<nav class="sidebar-nav"><ul><li><a href="/intro">Introduction</a></li><li><a href="/list">list</a></li><li><a href="/sort">sort</a></li><li><a href="/trim">trim</a></li></ul></nav>
<div role="main" class="document"><h1>sort</h1><p>Writes the lines of its input in order. Lines that compare equal keep the order in which they were read.</p>
<pre>sort [-r] [-n] [file ...]</pre><h2>Options</h2><dl><dt>-r</dt><dd>Reverses the order of the result.</dd><dt>-n</dt><dd>Compares by numeric value, not by characters.</dd></dl>
<p>Without a file the standard input is read to its end before anything is written.</p></div>
<footer>Manual, edition 4</footer></body></html>""",
        "sort\nWrites the lines of its input in order. Lines that compare equal keep the order in which they were read.\nsort [-r] [-n] [file ...]\nOptions\n-r\nReverses the order of the result.\n-n\nCompares by numeric value, not by characters.\nWithout a file the standard input is read to its end before anything is written.",
    ),
    (
        """<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD COLSPAN=2><A HREF="index.html"><B>Museum of Clocks</B></A></TD></TR>
<TR><TD WIDTH=150><A HREF="visit.html">Visit us</A><BR><A HREF="hours.html">Opening hours</A><BR><A HREF="shop.html">Shop</A><BR><A HREF="map.html">Map</A></TD>
<TD><H1>The tower clock of 1720</H1><P>This clock was made for the town hall and ran there for almost two hundred years, wound by hand every morning.
<P>Its pendulum is four metres long and swings once in two seconds, which visitors can watch from the gallery on the first floor.
<P>The wheels were cut by a single maker, whose name is scratched on the back of the largest of them.</TD></TR>
<TR><TD COLSPAN=2><FONT SIZE=1>Last changed in May. <A HREF="mailto:x@example.org">Write to the webmaster</A></FONT></TD></TR></TABLE></BODY></HTML>""",
        "The tower clock of 1720\nThis clock was made for the town hall and ran there for almost two hundred years, wound by hand every morning.\nIts pendulum is four metres long and swings once in two seconds, which visitors can watch from the gallery on the first floor.\nThe wheels were cut by a single maker, whose name is scratched on the back of the largest of them.",
    ),
    (
        """<html><head><meta charset=utf-8></head><body><div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
<section class="content"><h1>Bread with seeds</h1><p>Mix the flour, the water and the salt and let the dough rest for an hour under a cloth.</p>
<ul><li>500 g of strong flour</li><li>350 g of water</li><li>a spoon of salt and two of seeds</li></ul>
<div class="ad-container"><p>Try our new knives, now half price!</p></div>
<p>Bake it in a hot oven until the crust is dark and the loaf sounds hollow when you knock on it.</p></section>
<form class="newsletter"><p>Get a recipe every week</p><input name=e><button>Sign up</button></form>
<div class="footer"><a href="/imprint">Imprint</a></div></body></html>""",
        "Bread with seeds\nMix the flour, the water and the salt and let the dough rest for an hour under a cloth.\n500 g of strong flour\n350 g of water\na spoon of salt and two of seeds\nBake it in a hot oven until the crust is dark and the loaf sounds hollow when you knock on it.",
    ),
    (
        "<p>A page of one paragraph, with no markup to speak of, that someone saved from a letter long ago.</p>",
        "A page of one paragraph, with no markup to speak of, that someone saved from a letter long ago.",
    ),
]


def test_extraction_of_pages_written_by_hand():
    got = html_extract.extract_batch([html for html, _ in WRITTEN], html_extract.model())
    words = hit = told = 0
    for text, (_, want) in zip(got, WRITTEN, strict=True):
        a, b = Counter(want.split()), Counter(text.split())
        words, hit, told = words + a.total(), hit + (a & b).total(), told + b.total()
    assert sum(x == y for x, (_, y) in zip(got, WRITTEN, strict=True)) >= 4
    assert hit / words > 0.95 and hit / told > 0.95


def test_inline_markup_hides_no_text():
    """Only what is no text of a page is left out: what stands in an article's other inline elements stays."""
    page = "<article><p>One <abbr>two</abbr> <mark>three</mark> <q>four</q> <kbd>five</kbd> <font>six</font> <ins>seven</ins> <cite>eight</cite> and many more words to read here, as in any article.</p></article>"
    (got,) = html_extract.extract_batch([page], html_extract.model())
    assert got == "One two three four five six seven eight and many more words to read here, as in any article."


@pytest.mark.parametrize("page", ["", "<", "<p", "<!--", "<script>", "</p></div>x", "<div>" * 5000 + "x", '<a href="x>y</a> z', "<td><li><p></ul>", "<a" * 5000, "&#x110000; &bogus;"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_extract.extract_batch([page], html_extract.model())[0], str)


def test_text_of_a_page(spark):
    html = "<html><body><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>A  title</h1><p>One &amp; two,\n three &lt;b&gt; and many more words to read here.<p><b>Four</b> five.<br></article><footer>&copy; x</footer></body></html>"
    df = spark.createDataFrame([(1, "u", html, "t"), (2, "u", None, "t"), (3, "u", html, "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df, drop_html=True).collect()}
    assert got[1].text == got[3].text == "A title\nOne & two, three <b> and many more words to read here.\nFour five."
    assert got[2].text == "" and got[1].n_chars == len(got[1].text) and html_extract.extract(df.limit(0)).count() == 0


def test_decoding_against_every_assignment():
    r = np.random.default_rng(3)
    allowed = {html_extract.CONTAINER: (0, 1, 2), html_extract.CONTENT: (1, 2), html_extract.DROPPED: (2,)}
    for _ in range(80):
        blocks = [html_extract.Block("div", "", -1, 0)]
        for i in range(1, r.integers(1, 8)):
            parent = int(r.integers(0, i))
            blocks.append(html_extract.Block("p", "", parent, 1))
            blocks[parent].kids.append(i)
        for b in blocks:
            b.own, b.hidden = int(r.integers(0, 200)), bool(r.random() < 0.1)
        z = r.normal(scale=3, size=len(blocks))
        own = html_extract.values(blocks, z)
        best = max(sum(own[i][s] for i, s in enumerate(states)) for states in itertools.product(range(3), repeat=len(blocks)) if all(states[i] in allowed[states[b.parent]] for i, b in enumerate(blocks) if i))
        got = html_extract.states(blocks, z)
        assert all(got[i] in allowed[got[b.parent]] for i, b in enumerate(blocks) if i)
        assert sum(own[i][s] for i, s in enumerate(got)) == pytest.approx(best)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    kinds = {"aa": ["th", "ing", "on", "er", "an"], "bb": ["sch", "ung", "keit", "ü", "ge"]}
    speak = lambda k, n: " ".join("".join(r.choices(kinds[k], k=r.randint(2, 5))) for _ in range(n))
    rows = [(i, speak(k, 60), k, "s", 0) for i in range(120) for k in [("aa", "bb")[i % 2]]]
    item = speak("aa", 30)
    rows += [(200, rows[3][1], "bb", "s", 0), (201, speak("aa", 40) + " " + item + " " + speak("aa", 40), "aa", "s", 0), (202, None, None, "s", 0), (203, "123 !!", None, "s", 0), (204, speak("aa", 50) + " write to a.b@c.de", "aa", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == {*range(120), 204} and left[204].endswith("write to [EMAIL]")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(left)


CLASHES = ("score", "rejected", "lang_pred", "__t", "__m_email", "__leak", "__gone", "fp", "keys", "sketch", "item_id", "rep")


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    speak = lambda k, n: " ".join("".join(r.choices({"aa": ["th", "ing", "on"], "bb": ["sch", "ung", "ü"]}[k], k=r.randint(2, 5))) for _ in range(n))
    rows = [(i, speak(("aa", "bb")[i % 2], 40), ("aa", "bb")[i % 2], *(["mine"] * len(CLASHES))) for i in range(60)]
    rows += [(None, speak("aa", 40), "aa", *(["mine"] * len(CLASHES))), (70, rows[0][1], "aa", *(["mine"] * len(CLASHES)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHES))
    spark.createDataFrame([(0, rows[4][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == ["doc_id", "text", "lang", *CLASHES]
    got = docs.collect()
    assert all(x[c] == "mine" for x in got for c in CLASHES)
    assert {x.doc_id for x in got} == {None, *range(60)} - {4}
    assert {x.doc_id for x in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == {None, *range(60)} - {4}


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    none = spark.createDataFrame([(1, None, None, None, None), (2, "", "aa", "s", 0)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).columns == none.columns


@pytest.mark.parametrize("part", ["<svg width='1'/>", "<math/>", "<datalist><option>unseen<option>unseen</datalist>", "<button>unseen<div>unseen</button>", "<div><select><option>unseen</div>", "<svg><path d=''/><style/><text>unseen</text></svg>", "<svg><g>unseen", "<template><p>unseen</p></template>"])
def test_only_raw_text_hides_what_follows(part):
    blocks = html_extract.parse(f"<div><p>first</p>{part}<p>second</p></div><p>third</p>")
    seen = "".join(x for b in blocks for x in b.pieces if isinstance(x, str))
    assert seen == "firstsecondthird"
