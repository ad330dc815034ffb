"""Main texts against a plain reading of the test pages, and the rules of alignment."""

import html
import re

from inkprint.llm import wrappers

SF = "/root/testdata/sf0.001"


def slow_text(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)]
    return "\n".join(b for b in blocks if b)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in wrappers.main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert (got[r.page_id].url, got[r.page_id].text) == (r.url, slow_text(r.html))
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def wrapper_of(*pages):
    out = wrappers.expression(pages[0])
    for p in pages[1:]:
        out = wrappers.merged(out, wrappers.expression(p))
    return out


def test_optional_and_repeated_groups():
    made = wrapper_of("<div><h1>a</h1><p>x</p></div>", "<div><h1>b</h1><ul><li>1<li>2</ul><p>x</p><p>y</p></div>")
    assert wrappers.shown(made) == "<>(<div>(<h1>(#)<ul>(<li>(#)+)?<p>(#)+))"
    made = wrapper_of("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")
    assert wrappers.shown(made) == "<>(<dl>((<dt>(#)<dd>(#))+))"


def read(page):
    return wrappers.extract(page, wrappers.labelled(wrappers.expression(page)))


def test_what_stays_and_what_goes():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
    <header>H</header><nav><ul><li>M</ul></nav><div class="cookie-notice">N</div><!-- <p>c</p> -->
    <main><article><h1>Title &amp; more</h1><p>One <b>bold</b>&nbsp; word<p>Two<br>Three <script>if (a<b) "</p>"</script>
    <div id='ad-3'>Ad</div><table><tr><td>c1<td>c2</table><form>F<input></form><aside>S</aside></article>
    <section class="comments"><p>Reader</section></main><footer>F</footer></body></html>"""
    assert read(page) == "Title & more\nOne bold word\nTwo\nThree\nc1\nc2"
    assert read("<body><nav>M</nav><p>a</p>b<p>c &lt;x&gt; &amp;amp;") == "a\nb\nc <x> &amp;"
    assert [read(x) for x in ("", "  ", "<", "<p", "a<b", "</p>x</div>", "<!-- x")] == ["", "", "<", "", "a", "x", ""]
    assert read("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert read("<article><p>x</article>" + "<p>y" * 3) == "x"


def test_odd_tables(spark):
    rows = [(1, None, "<p>a"), (None, "http://h.x/1", None), (2, "http://h.x/2", ""), (3, "nonsense", "<article>z"),
            (3, "nonsense", "<article>z")] + [(9 + k, "http://hot.x/", f"<article><p>{k}</article><p>out") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' AS host", "1 AS salt")
    got = wrappers.main_text(pages).collect()
    assert len(got) == len(rows) and wrappers.main_text(pages.limit(0)).count() == 0
    by = {r.page_id: r.text for r in got}
    assert (by[1], by[None], by[2], by[3], by[40]) == ("a", "", "", "z", "31")


def test_the_host_decides(spark):
    frame = "<ul class=links><li>Home<li>About</ul>{}<div class=disclaimer>All rights reserved.</div>"
    plain = [(k, f"http://a.x/{k}", frame.format(f"<p>Story number {k} is told here at some length.")) for k in range(6)]
    main = [(10 + k, f"http://b.x/{k}", f"<article><p>Report {k} has these words in it, and more.<p>Follow us</article>")
            for k in range(6)]
    form = [(20 + k, f"http://c.x/{k}", f"<form><div><p>Page {k} stands in a form as a whole.</div><nav>M</nav></form>")
            for k in range(6)]
    same = [(30 + k, f"http://d.x/{k}", f"<p>A long text that is nearly the same on all of the pages.<p>No {k}") for k in range(6)]
    copies = [(40 + k, f"http://e.x/{k}", "<article><p>One page, many times.</article>") for k in range(6)]
    few = [(50 + k, f"http://f.x/{k}", frame.format(f"<p>Story {k}")) for k in range(2)]
    pages = spark.createDataFrame(plain + main + form + same + copies + few, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_text(pages).collect()}
    for k in range(6):
        assert got[k] == f"Story number {k} is told here at some length."
        assert got[10 + k] == f"Report {k} has these words in it, and more.\nFollow us"  # an article keeps all its text
        assert got[20 + k] == f"Page {k} stands in a form as a whole."
        assert got[30 + k] == f"A long text that is nearly the same on all of the pages.\nNo {k}"
        assert got[40 + k] == "One page, many times."
    assert got[50] == "Home\nAbout\nStory 0\nAll rights reserved."


def test_main_region_keeps_what_repeats_and_what_a_word_hints_at(spark):
    """An opening paragraph of all pages of a host stays in the article, and so does a section on related work."""
    def page(k):
        return (f'<nav>menu</nav><div class="notice-bar">closed</div><article><p>Breaking news from town today</p><p>own text {k}</p>'
                f'<section class="related-work"><p>work of others {k}</p></section><div class="comment-list"><p>hello</p></div>'
                f'<div id="share this">tell</div></article><div class="sidebar-left">side</div>')

    rows = [(k, "http://h.org/x", page(k)) for k in range(6)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Breaking news from town today\nown text {k}\nwork of others {k}" for k in range(6)}
