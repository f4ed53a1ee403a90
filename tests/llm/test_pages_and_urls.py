import numpy as np

from bitquarry.llm.html_text import extract, main_blocks
from bitquarry.llm.url_filter import cascade, listed_by, verdicts

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site-header"><h2>Site</h2></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav>
<div class="cookie-notice">We use cookies here, a long sentence that looks like any text of the page.</div>
%s
<section id="comments"><h3>Comments</h3><p>A reader writes a very long comment that is as long as the article itself, and more of it.</p></section>
<aside>Related things and more</aside><form><label>Name</label><input></form><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    article = "<article><h1>Head &amp; tail</h1><p>First  <b>bold</b>\n text<br>next line<p>Second &eacute; &#x41; paragraph<ul><li>one<li>two</ul><!-- no --></article>"
    want = "Head & tail First bold text next line Second é A paragraph one two"
    assert " ".join(main_blocks(PAGE % article)) == want
    plain = "<div id='content'><h1>Head</h1>" + "<p>" + "some words of the long article text " * 12 + "</p>" * 2 + "<p>" + "more of it follows here " * 15 + "</p></div>"
    got = " ".join(main_blocks(PAGE % plain))
    assert got.startswith("Head some words") and got.endswith("follows here") and "cookies" not in got and "reader" not in got


def test_broken_and_empty_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<html><body><article><p>cut of"), (4, "u", "<p>"), (5, "u", "plain & simple"), (5, "u", "plain & simple"), (6, "u", "<article>" + "<p>word</p>" * 20000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("x", "text")
    got = sorted((r.page_id, r.text if r.page_id < 6 else "", r.n_chars) for r in extract(df).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "cut of", 6), (4, "", 0), (5, "plain & simple", 14), (5, "plain & simple", 14), (6, "", 99999)]
    assert extract(df.limit(0)).count() == 0


def test_broken_declarations_and_comments_do_not_stop_a_page():
    for bad in ("<![foo[bar]]>", "<![ x>", "<![%x>", "<![if !IE]>"):
        assert " ".join(main_blocks(f"<article><p>before {bad}after</p></article>")).startswith("before")
    assert main_blocks("<article><p>before</p><![%x") == ["before"]
    assert main_blocks("<article><p>text of it</p></article><!-- cut off <p>never</p>") == ["text of it"]


def test_the_threshold_decides():
    import bitquarry.llm.html_text as h

    long_ = "<p>" + "words of a long text beside it " * 30 + "</p>"
    page = f"<article><p>short</p></article><div>{long_}{long_}</div><div>x</div><div><a>y</a> <a>z</a></div>"
    assert " ".join(main_blocks(page)).count("long text") == 60
    before = h.threshold
    try:
        h.threshold = lambda x: float(x.max()) + 1
        assert main_blocks(page) == []
    finally:
        h.threshold = before


def test_text_elements_keep_their_text():
    page = "<article><p class='share-price'>prices rose</p><figure><figcaption>a caption</figcaption></figure><p>" + "text " * 60 + "</p><p class='ad'>buy</p><div class='share-buttons'>share</div></article>"
    got = " ".join(main_blocks(page))
    assert got.startswith("prices rose a caption text") and "buy" not in got and not got.endswith("share")


def test_cascade_is_exact():
    rng = np.random.default_rng(3)
    for n, m in ((0, 10), (10, 0), (1000, 5000), (5000, 300)):
        keys = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64))
        listed, others = keys[:n], keys[n:]
        levels = cascade(listed, others)
        assert listed_by(levels, listed).all() and not listed_by(levels, others).any()


def python_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://Example.com", "http://example.com/en/", "https://a.example.com/en/x?q#f", "https://WWW.example.com/en/", "https://x.www.example.com/en/1", "http://example.com/en", "http://notexample.com/en/", "http://e.net/es/", "http://net/fr/a", "http://e.net/esx/", "http://e.net?x=/es/", "http://e.net#/es/", "ftp://e.org/a://b.com/", "http://İ.net/fr/", "http://e.net/es/\nnew"]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string")
    plain = {i: python_verdict(u) for i, u in enumerate(URLS + URLS[:3])}
    listed = {h for h, _, _, v in plain.values() if v == "block"}  # hosts of which a rule blocks a page
    want = {i: (h, p, r, v if r else "block" if h in listed else "allow") for i, (h, p, r, v) in plain.items()}
    assert sum(want[i] != plain[i] for i in plain) == 4
    for most in (1 << 26, 0):
        got = {r.page_id: (r["__bq_host"], r["__bq_path"], r["__bq_rule"], r["__bq_verdict"]) for r in verdicts(df, most_bytes=most, shard_keys=5).collect()}
        assert got == want
    blocked = spark.createDataFrame([("e.org",), ("example.com",)], "host string")
    got = {r.page_id: r["__bq_verdict"] for r in verdicts(df, blocked=blocked).collect()}
    assert got[16] == "block" and got[9] == "allow" and got[4] == "block"
    got = {r.page_id: r["__bq_verdict"] for r in verdicts(df.filter("page_id in (9, 13, 16)")).collect()}
    assert set(got.values()) == {"allow"}
    assert verdicts(df.limit(0)).count() == 0
