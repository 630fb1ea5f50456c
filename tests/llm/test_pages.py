import re

import html as entities
import pytest

from lullwatch.llm import pages as P
from tests.llm.conftest import SF, write_tables

ODD = {
    None: "", "": "", "plain  text\n here": "plain text here", "<p>a<p>b&amp;c<br>d": "a\nb&c d",
    "<body><nav><p>menu</p></nav><div class='ad-box'>buy</div><article><h1>T</h1><p>x <b>y</p><p>z</article><footer>f</footer>": "T\nx y\nz",
    "<article><header><h1>T</h1><p>by me</p></header><p>t<script>var a='<p>q</p>';</script>u</p><aside>s</aside><form>f</form></article><section id=comments><article class=comment><p>c</p></article></section>": "T\ntu",
    "<div><p>one</p><div class=sidebar><p>s</div><p>two &lt;b&gt; &#233;&nbsp;x</p></div>": "one\ntwo <b> é x",
    "<main>a<div class='cookie-notice'>n</div>b<ul><li>1<li>2</ul></main><!-- no --><style>p{}": "a\nb\n1\n2",
    "<article><p>cut <b": "cut", "<p>1 < 2 and 3 > 2</p>": "1 < 2 and 3 > 2", "<article><p class=lead>a</p><blockquote>q</blockquote><pre>p  p</pre>": "a\nq\np p",
}


@pytest.mark.parametrize("page", list(ODD))
def test_blocks(page):
    assert P.extract(page, {}) == ODD[page]


def test_wrapper_finds_the_template():
    pages = [f"<body><div><p>Welcome to the site</p></div><div id=t><p>text {k}</p>{'<p>more</p>' * k}</div>{'<div><i>opt</i></div>' if k % 2 else ''}</body>" for k in range(5)]
    template = P.infer(pages)
    assert template == {"body/div/p": "Welcome to the site"} and P.extract(pages[2], template) == "text 2\nmore\nmore"
    assert P.infer(pages[:2]) == {} and P.infer([pages[0]] * 5) == {}


def test_query(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in P.op9_main_text(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(k, None if k % 3 else f"http://h{k % 2}.org/{k}", p, "clash") for k, p in enumerate(ODD)] * 2 + [(None, "x", "<p>w</p>", "")], "page_id long, url string, html string, text string")
    out = P.op9_main_text(spark, write_tables(tmp_path / "t", pages=odd)).collect()
    assert len(out) == 2 * len(ODD) + 1 and all(r.text == list(ODD.values())[r.page_id] for r in out if r.page_id is not None)
    assert P.op9_main_text(spark, write_tables(tmp_path / "e", pages=odd.limit(0))).count() == 0


def host_pages(n, odd):
    """Pages of a host without article: page ``odd`` has another text where all others repeat one; ``h1`` texts are the same on all pages."""
    return [f"<body><div id=top><h2>Always here</h2></div><div id=w><p>{'Changed' if k == odd else 'Welcome'}</p></div><div id=t><p>text {k}</p>{'<p>more</p>' * (k % 3)}</div>"
            f"{'<div><h3>opt</h3></div>' if k % 2 else ''}</body>" for k in range(n)]


def test_wrapper_reads_all_pages_of_a_host(spark):
    n = 60
    # whichever pages are looked at, the one that differs counts, also a very long one
    for odd, more in ((7, ""), (41, ""), (23, "<div id=z><p>" + "x " * 120_000 + "</p></div>")):
        pages = host_pages(n, odd)
        pages[odd] += more
        frame = spark.createDataFrame([(k, f"http://a.org/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string").repartition(7)
        for together in (P.TOGETHER, 9):
            got = {r.page_id: r.text.split("\n") for r in P.main_text(frame, together).collect()}
            assert all("Always here" not in t and ("Changed" if k == odd else "Welcome") in t and f"text {k}" in t for k, t in got.items()) and len(got) == n, (odd, together)
    assert "Welcome" in {t for t in P.infer(host_pages(n, None)).values()}


def test_wrappers_of_groups_agree_with_one_pass():
    pages = host_pages(60, 17)
    whole = P.infer(pages)
    assert set(whole.values()) == {"Always here"}
    for size in (1, 5, 13, 40):
        top = P.Wrapper()
        for k in range(0, len(pages), size):
            part = P.Wrapper()
            for page in pages[k:k + size]:
                part.add(1, False, P.stream(page))
            top.add(part.n, part.varies, part.items)
        assert top.n == 60 and top.template() == whole, size


def test_long_alternations_are_aligned_without_pairs():
    left, right = ["h", "p"] * 30_000 + ["f"], ["x"] + ["h", "p"] * 29_000 + ["f"]
    found = P.matches(left, right)
    assert found[-1] == (60_000, 58_001) and len(found) == 58_001 and all(left[a] == right[b] for a, b in found)
    assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))
