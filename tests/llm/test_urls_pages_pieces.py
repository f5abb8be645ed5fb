"""URL filter, main text and sampled pieces."""

from __future__ import annotations

import math
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotflow.llm import htmltext, pieces, queries, urls
from slotflow.llm.labelled_pages import LABELLED
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_url_filter_like_sql(spark):
    assert compare(spark, connect(SF), "op2", queries.op2_url_filter, queries.SQL["op2_url_filter"], SF) == []


def test_two_part_suffixes_like_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    hosts = ["a.b.co.uk", "c.b.co.uk", "d.org.uk", "co.uk", "x.com.au", "y.x.com.au", "e.com", "f.e.com", "g.gov.in", "10.1.2.3", "local", "h.co.it:8080", "i.github.io"]
    pages = [(i, f"http://{hosts[rng.integers(len(hosts))]}/p/{i}" + ("/x" if i % 3 else "/"), i) for i in range(400)] + [(900, None, 0), (901, "http://a.b.co.uk/none", 0)]
    labels = [(i, int(rng.random() < 0.5), int(rng.random() < 0.2)) for i in range(0, 400, 2)] + [(4, 0, 1), (None, 0, 1), (5, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, number long").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert compare(spark, con, "op2", queries.op2_url_filter, queries.SQL["op2_url_filter"], str(tmp_path)) == []


def test_urls_by_hand(spark):
    rows = [
        ("http://A.Example.COM/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://m.www.example.com/en/9", "m.www.example.com", "/en/9", "www.example.com/en/", "allow"),
        ("https://notexample.com/en/9", "notexample.com", "/en/9", "com/", "allow"),
        ("https://example.com", "example.com", "", None, "allow"),
        ("x://net/es/1", "net", "/es/1", "net/es/", "block"),
        ("x://a.net/ES/1", "a.net", "/ES/1", None, "allow"),
        ("x://a.net?q=://b.com/", "a.net", "", None, "allow"),
        ("x://a.net#f/fr/", "a.net", "", None, "allow"),
        ("://É.Net/fr/\n/z", "É.net", "/fr/\n/z", "net/fr/", "block"),
        ("no scheme.com/en/", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x:///path", "", "/path", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, r[0], "old", None) for i, r in enumerate(rows)], "page_id long, url string, host string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, queries.RULES).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}
    assert urls.judge(pages.limit(0), queries.RULES).collect() == []


def test_reputation_shrinks_to_the_domain(spark):
    hosts = [("bad.a.org", 400, 300), ("worse.a.org", 300, 240), ("new.a.org", 0, 0), ("few.b.org", 2, 2)]
    hosts += [(f"h{i}.b.org", 100 + i, 8 + i % 5) for i in range(20)] + [(f"n{i}.c.net", 50, 4) for i in range(10)] + [("localhost", 0, 0), ("10.0.0.1", 5, 1), ("x.y.co.uk:80", 3, 0)]
    got = {r.host: r for r in urls.reputation(spark.createDataFrame(hosts, "host string, n long, x long")).collect()}
    assert len(got) == len(hosts)
    assert got["bad.a.org"].bound > 0.6 and got["h3.b.org"].bound < 0.2
    assert got["few.b.org"].bound < got["bad.a.org"].bound  # two pages are little evidence
    assert got["new.a.org"].bound > got["localhost"].bound  # its domain is known to be bad
    assert (got["x.y.co.uk:80"].domain, got["x.y.co.uk:80"].suffix) == ("y.co.uk", "co.uk")
    assert (got["10.0.0.1"].domain, got["10.0.0.1"].suffix, got["localhost"].domain) == ("10.0.0.1", "", "localhost")


def test_reputation_blocks(spark):
    pages = [(f"http://bad.net/{i}", 1 if i % 10 else 0) for i in range(200)] + [(f"http://good{i % 9}.org/{i}", 0) for i in range(300)] + [("http://bad.net/z", None)]
    got = urls.judge(spark.createDataFrame(pages, "url string, bad int"), []).select("host", "verdict").distinct().collect()
    assert {r.verdict for r in got if r.host == "bad.net"} == {"block"} and {r.verdict for r in got if r.host != "bad.net"} == {"allow"}


@pytest.fixture(scope="module")
def tree():
    return htmltext.fit(LABELLED)


def test_labelled_pages_come_back(tree):
    for page, main in LABELLED:
        assert htmltext.extract(page, tree).split("\n") == main


PAGES = [
    ("<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One<b>two</b>\n three&nbsp;four<br>five<p>Six</article><footer>F</footer>", "T & U\nOnetwo three four five\nSix"),
    ("<article><p>a &lt;b&gt; &#233;&#x41; &copy; &unknown; 1 < 2 & 3</p></article>", "a <b> éA © &unknown; 1 < 2 & 3"),
    ("<article><script>var t='</p>';</script><p>Kept<!-- no </p> --> text</p><style>p{}</style></article>", "Kept text"),
    ('<article><p>Kept</p><div class="ad">Buy</div><div class="cookie-notice">We</div><form><p>Name</p></form><p>Too</p></article><div class="comments"><p>Nice words from a reader who came by</p></div>', "Kept\nToo"),
    ("<ARTICLE><P TITLE='a > b'>Upper</P></ARTICLE>", "Upper"),
    ("<article><p>cut off <a href='x'>here</a> and th</p><p>last</p></artic", "cut off here and th\nlast"),
    ("</div></p><article><p>stray ends</p></span></b></article>", "stray ends"),
    ("<article><p>never closed <!-- comment", "never closed"),
    ("<article><p>a</p><script>unclosed <p>b</p>", "a"),
    ('<body class="nav-open"><article class="post comments-open tags"><header><h1>Head</h1></header><p>Body</p></article></body>', "Head\nBody"),
    ('<header><h1>Site</h1></header><aside>More</aside><div class="side-bar sidebar"><p>Side</p></div><article><p>Only this</p></article>', "Only this"),
    ("", ""),
    (None, ""),
    ("<html><head><title>only</title></head><body></body></html>", ""),
]


A = "The council met on Monday to talk of the bridge, which has been shut since a lorry struck its eastern arch in the spring floods."
B = "Repairs will cost more than was thought, the engineer told the room, for the stone must come from the same quarry as before."
L = f"<p>{A}</p><p>{B}</p>"
AB = f"{A}\n{B}"
MORE = [
    # names of wrappers, and attributes that only mention words
    (f'<div class="layout with-sidebar"><article>{L}</article></div>', AB),
    (f'<article title="The hidden valley">{L}</article>', AB),
    (f'<article data-title="The hidden valley">{L}</article>', AB),
    (f'<article><header class="entry-header"><h1>Title</h1></header>{L}</article>', f"Title\n{AB}"),
    (f'<article>{L}<p class="advert">Buy a boat this week, at half the price of the old one.</p></article>', AB),
    (f"<article>{L}<p hidden>Not shown to anyone who reads this page.</p></article>", AB),
    (f"<article>{L}<ul><li class=share>Share it<li>First point<li>Second point</ul></article>", f"{AB}\nFirst point\nSecond point"),
    (f'<div class="social-history">{L}</div>', AB),
    ("<p>One short line.</p><p>Another.</p>", "One short line.\nAnother."),
    ("Plain text without tags", "Plain text without tags"),
    # hidden by attributes of every spelling, and names that are no attribute of the kind
    (f'<article><div style="color: red; DISPLAY : none">Gone</div><div aria-hidden="true">Gone</div><div HIDDEN>Gone</div>{L}</article>', AB),
    (f'<article data-hidden="x" class="hidden-gem"><p style="color:none">{A}</p><p>{B}</p></article>', AB),
    (f'<body class="page-with-comments single-post"><main id="main-content">{L}</main><div class="comment-list"><p>{B}</p></div></body>', AB),
    (f'<article class="post tag-news category-adverts comments-open">{L}</article><article class="comment"><p>I saw that lorry too.</p></article>', AB),
    # menus, asides and feet of every kind
    (f'<ul class="nav-menu"><li><a href=a>One</a><li><a href=b>Two</a></ul><div id="content">{L}</div><div id="site-footer"><p>All the rights</p></div>', AB),
    (f'<div class="breadcrumbs"><a href=a>Home</a> &gt; News</div><article>{L}<aside>Pull this out</aside><footer>By a writer</footer></article>', AB),
    (f'<div class="cookieNotice">We use cookies on all of these pages.</div><article>{L}</article>', AB),
    (f'<div id="adSlot"><p>{B} {A}</p></div><article>{L}</article>', AB),
    (f'<section class="newsletter-signup"><p>Read us every morning, before you read anyone else.</p></section><main>{L}</main>', AB),
    (f'<div class="share-buttons">Send it to a friend</div><div class="post-body">{L}</div><div class="related-posts"><h3>More</h3><p>Old bridges</p></div>', AB),
    (f'<article>{L}</article><section id="disqus_thread"><p>{A} I doubt it.</p><p>{B} So do I.</p></section>', AB),
    (f'<form action="/"><main>{L}</main><div class="search-form">Find</div></form>', AB),
    (f'<main>{L}<form><p>Write to the council here, in a few words.</p></form></main>', AB),
    # markup that ends late, early or never
    (f"<article><p>{A}<p>{B}<div class=ad>Buy</article><p class=legal>Rights", AB),
    (f"<article><table><tr><td>{A}<td class=ad>Buy<tr><td>{B}</table></article>", AB),
    (f"<article><dl><dt class=share>Share<dd>{A}<dd>{B}</dl></article>", AB),
    (f"<article>{L}<p>It is <span class=ad>sold</span>shut</p></article>", f"{AB}\nIt is\nshut"),
    (f"<article><h2>Arch<h2>Stone</h2>{L}</article>", f"Arch\nStone\n{AB}"),
    (f"<article>{L}<svg><text>x</text><p>Kept</p></article>", f"{AB}\nx\nKept"),
    (f"<article>{L}<blockquote>Short.</blockquote><pre>a  b\n c</pre></article>", f"{AB}\nShort.\na b c"),
    # pages without an article element
    (f"<div><a href=a>Home</a> <a href=b>News</a></div><div><h1>Bridge</h1>{L}<p>Yes.</p></div>", f"Bridge\n{AB}\nYes."),
    (f"<table><tr><td><a href=a>Home</a><td>{L}</table>", AB),
]


def test_ordinary_markup(tree):
    for page, want in MORE:
        assert htmltext.extract(page, tree) == want, page
        assert htmltext.extract(f"<html><head><title>t</title></head><body>{page}</body></html>", tree) == want, page


def test_half_of_the_labelled_pages_predicts_the_other():
    right = total = 0
    for fold in (0, 1):
        half = htmltext.fit(LABELLED[fold::2])
        for page, main in LABELLED[1 - fold :: 2]:
            found = htmltext.blocks(page)
            kept = half.main(htmltext.features(found))
            right += sum(bool(k) == (b.text in main) for b, k in zip(found, kept))
            total += len(found)
    assert right / total > 0.9


def test_words_and_links_lead(tree):
    first = htmltext.FEATURES[int(tree.nodes[0][0])]
    assert first in htmltext.FEATURES[: htmltext.LEADING] and {"words", "links"} <= set(htmltext.FEATURES[: htmltext.LEADING])
    assert len({int(n[0]) for n in tree.nodes if n[0] >= 0} & set(range(htmltext.LEADING))) >= 2


def test_pages_by_hand(spark, tree):
    frame = spark.createDataFrame([(i, p, "clash") for i, (p, _) in enumerate(PAGES)], "page_id long, html string, text string")
    got = {r.page_id: r.t for r in frame.select("page_id", htmltext.main_text(F.col("html"), tree).alias("t")).collect()}
    for i, (page, want) in enumerate(PAGES):
        assert got[i] == want, page


@pytest.mark.parametrize(
    ("head", "want"),
    [
        ("<html><head><title>T</title>", "Kept text"),
        ("<HEAD><META charset=utf-8><link rel=x><base href=y>\n<!-- <p>no</p> --><style>p{}</style><script>'<p>no</p>'</script>", "Kept text"),
        ("<head><noscript><img src=x></noscript><template><p>no</p></template><noframes><p>no</p></noframes>", "Kept text"),
        ("<head><title>T</title><body>", "Kept text"),
        ("<head><title>T</title></title></head >", "Kept text"),
        ("<head><title>T</title></body>", "Kept text"),
        ("<head><title><p>T</title><meta name=a content='<article>'><script>'</head>'</script><title>U</title></head>", "Kept text"),
        ("<head><title>T</title><header><h1>Site</h1></header>", "Kept text"),
    ],
)
def test_heads_without_an_end(tree, head, want):
    assert htmltext.extract(f"{head}<article><p>Kept text</p></article>", tree) == want


def test_text_ends_a_head():
    assert [b.text for b in htmltext.blocks("<head><title>T</title> \n Words <b>here</b><p>more")] == ["Words here", "more"]
    assert htmltext.blocks("<head><title>T</title> \n ") == [] == htmltext.blocks("<head>")


def test_long_and_hostile_pages(tree):
    body = "<p>" + "word " * 400_000 + "</p>"
    assert len(htmltext.extract(f"<article>{body}</article>", tree)) == 400_000 * 5 - 1
    deep = "<div>" * 20_000 + "<article><p>deep text</p></article>"
    assert htmltext.extract(deep, tree) == "deep text"
    assert isinstance(htmltext.extract("<a href=\"" * 2_000, tree), str)
    for piece in ("<svg><p>x", "<li class=ad>x", "<div class=ad><p>x", "</div>", "<span class=ad>x", "<td>x", "<math>"):
        assert isinstance(htmltext.extract(piece * 20_000, tree), str)


def test_tree_splits_what_it_can():
    x = np.array([[1.0, 0.0], [2.0, 0.0], [3.0, 1.0], [4.0, 1.0]])
    grown = htmltext.grow(x, np.array([0.0, 1.0, 1.0, 0.0]))
    assert grown.main(x).tolist() == [False, True, True, False]


def test_main_text_query(spark):
    rows = queries.op9_html_text(spark, SF).collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert len(rows) == pages and all(r.n_chars == len(r.text) > 0 for r in rows)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(PATH)


def paths(word, vocabulary):
    """Every segmentation of a short word, with its weight."""
    if not word:
        yield (), 1.0
    for n in range(1, len(word) + 1):
        found = vocabulary.ids.get(word[:n])
        if found is not None:
            for rest, weight in paths(word[n:], vocabulary):
                yield (found, *rest), weight * math.exp(vocabulary.logs[found])


def test_samples_follow_the_path_weights(vocabulary):
    word, n = " theses", 40_000
    got, count = pieces.Lattices(vocabulary).sample([word] * n, pieces.mixed(np.arange(n, dtype=np.uint64)))
    ends = np.cumsum(count)
    seen = Counter(tuple(got[e - c : e].tolist()) for e, c in zip(ends, count))
    want = dict(paths(word, vocabulary))
    assert set(seen) <= set(want)
    total = sum(want.values())
    for path, weight in want.items():
        share = weight / total
        assert abs(seen[path] / n - share) < 6 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_all_words_of_two_letters_have_their_paths(vocabulary):
    lattices = pieces.Lattices(vocabulary)
    for word in map("".join, product(" aé", "bt", "s1")):
        got, _ = lattices.sample([word] * 200, pieces.mixed(np.arange(200, dtype=np.uint64)))
        assert b"".join(vocabulary.bytes[i] for i in got) == word.encode() * 200


def test_bounds_do_not_depend_on_the_batch(vocabulary):
    rng = np.random.default_rng(1)
    letters = [c for c in "abcdefghijklmnopqrstuvwxyz▁é" if c in vocabulary.ids]
    words = list({"".join(rng.choice(letters, rng.integers(1, 15))) for _ in range(600)})

    def edges(lattice, word):
        at, out = [lattice.ends[word]], {}
        while at:
            place = at.pop()
            if place < 0 or place in out:
                continue
            stop = lattice.first[place + 1] if place + 1 < len(lattice.first) else len(lattice.bounds)
            out[place] = [(lattice.bounds[e], lattice.piece[e]) for e in range(lattice.first[place], stop)]
            at += [int(lattice.before[e]) for e in range(lattice.first[place], stop)]
        return [out[k] for k in sorted(out)]

    together, alone = pieces.Lattices(vocabulary), pieces.Lattices(vocabulary)
    together.learn(words)
    for word in words:
        alone.learn([word])
        assert edges(together, word) == edges(alone, word), word


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(" ▁a\n\t\x00é中😀", max_size=30)), max_size=5), st.integers(-(2**63), 2**63 - 1))
def test_decoding_is_lossless(texts, key):
    vocabulary_ = CACHE.setdefault("v", pieces.Vocabulary(PATH))
    lattices = pieces.Lattices(vocabulary_)
    ids = pieces.encode_texts(texts, [key + i for i in range(len(texts))] if key < 2**62 else [key] * len(texts), lattices, 42)
    for text, own in zip(texts, ids):
        assert (own is None) == (text is None)
        if text is not None:
            assert pieces.decode_ids(own.tolist(), vocabulary_.bytes) == text


CACHE: dict = {}


def test_segmentation_depends_on_key_alone(spark):
    how = pieces.Sampler(PATH)
    text = "the reproducible segmentation of these words " * 5
    rows = [(1, text), (2, text), (1, text), (None, text), (3, None), (4, ""), (5, "x" * 300_000), (6, "two words " * 100_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    once = frame.select("doc_id", "text", pieces.encode(F.col("text"), F.col("doc_id"), how).alias("own"))
    again = frame.repartition(5).select("doc_id", pieces.encode(F.col("text"), F.col("doc_id"), how).alias("own"))
    got = once.select("doc_id", "own", (pieces.decode(F.col("own"), how) == F.col("text")).alias("same")).collect()
    assert got[0].own == got[2].own != got[1].own
    assert got[4].own is None and got[5].own == []
    assert all(r.same for r in got if r.doc_id != 3)
    assert sorted((r.doc_id or 0, r.own or []) for r in again.collect()) == sorted((r.doc_id or 0, r.own or []) for r in got)


def test_a_sharp_alpha_takes_the_best_path(vocabulary):
    sharp = pieces.Vocabulary(PATH, alpha=60.0)
    word = " theses"
    got, count = pieces.Lattices(sharp).sample([word] * 50, pieces.mixed(np.arange(50, dtype=np.uint64)))
    best = max(paths(word, sharp), key=lambda p: p[1])[0]
    assert got.tolist() == list(best) * 50
