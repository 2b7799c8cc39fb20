import html
import re

import numpy as np
import pytest

from lexilink.llm.blocklabel import Labeller
from lexilink.llm.htmlblocks import blocks
from lexilink.llm.htmltext import extract_text, main_texts
from lexilink.llm.pagemaker import make_pages


def by_tag(page):
    """The text of <article>, for pages that are known to mark it so."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_blocks():
    page = "<title>t</title><script>if(a<b){}</script><p>a <b>b\n c<br>d<p>e&amp;f&nbsp;g</p><!-- x <p>y -->h<ul><li>i<li>j</ul><td>k</b></p>&lt;p&gt"
    assert [b.text for b in blocks(page)] == ["a b c d", "e&f g", "h", "i", "j", "k", "<p>"]
    assert [b.text for b in blocks("a<br/>b</p>c<p")] == ["a b", "c"] and blocks("") == [] and blocks("<style>x") == [] and blocks(" \n") == []
    assert blocks("<div class='Side-bar x' id=mainMenu><a href=x>abc</a>d")[0].path.marks() == ["div", ".side", ".bar", ".x", ".main", ".menu"]
    assert [b.text for b in blocks("x < y > z <a")] == ["x < y > z"]


def test_held_out_accuracy():
    held = make_pages(300, seed=424242)
    labels = Labeller.load().label([f for f, _, _ in held])
    right = sum(int((a == y).sum()) for a, (_, y, _) in zip(labels, held, strict=True))
    assert right / sum(len(y) for _, y, _ in held) > 0.985
    assert 0.2 < np.concatenate([y for _, y, _ in held]).mean() < 0.9


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = Labeller.fresh()
    x = rng.normal(0, 1, (2, 4, len(model.p["wf"])))
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    y = rng.random((2, 4)) < 0.5
    _, grads = model.gradients(x, mask, y)
    for name in model.NAMES:
        at = tuple(rng.integers(0, s) for s in model.p[name].shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = model.gradients(x, mask, y)[0]
        model.p[name][at] = old - 1e-5
        down = model.gradients(x, mask, y)[0]
        model.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_table_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, by_tag(r.html)) for r in pages.collect()}
    got = {r.page_id: (r.url, r.text) for r in extract_text(pages).collect()}
    assert got == want


def test_edges(spark):
    df = spark.createDataFrame([(1, "u", None, "a"), (None, None, "", "b"), (2, "v", "<p>" * 3000, "c")], "page_id long, url string, html string, text string")
    assert sorted(((r.page_id, r.text, r.n_chars) for r in extract_text(df).collect()), key=repr) == [(1, "", 0), (2, "", 0), (None, "", 0)]
    assert extract_text(df.limit(0)).count() == 0
    long = "<body><nav><a href=x>a</a></nav><article>" + "<p>Some words that go on, é.</p>" * 20000 + "</article></body>"
    assert main_texts([long], Labeller.load())[0].count("\n\n") > 19000


def test_deep_pages_need_memory_by_elements():
    """Every nested element with a text of its own; a path's vector is the same either way it is found."""
    import tracemalloc

    from lexilink.llm import blocklabel

    deep = blocks("".join(f"<div class=c{i % 50}>t{i}" for i in range(300)))
    assert len(deep) == 300 and deep[-1].path.size == 600
    long = [blocklabel.path_vector(b.path) for b in deep]
    blocklabel._SHORT, before = 10**9, blocklabel._SHORT
    try:
        assert all(np.allclose(a, blocklabel.path_vector(b.path)) for a, b in zip(long, deep, strict=True))
    finally:
        blocklabel._SHORT = before
    tracemalloc.start()
    found = blocks("<div class=a>x" * 20000)
    blocklabel.vectors(found)
    assert len(found) == 20000 and tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
    assert len(blocks("<h1>a</q></section><x>" * 5000)) == 5000


def test_repeated_rows(spark):
    html_of = "<body><nav><a href=x>menu</a></nav><article>" + "<p>Some words of a longer text that go on and on.</p>" * 5 + "</article></body>"
    df = spark.createDataFrame([(1, "u", html_of)] * 3 + [(1, "v", html_of)], "page_id long, url string, html string")
    got = extract_text(df).collect()
    assert len(got) == 4 and len({r.text for r in got}) == 1 and got[0].n_chars > 100


def test_long_pages_by_segments_get_the_same_scores():
    import numpy as np

    from lexilink.llm.blocklabel import Labeller, vectors
    from lexilink.llm.htmlblocks import blocks

    page = "".join(f"<div class='{k}'><p>Some words here number {i}.</p><a href=x>more</a></div>" for i in range(300) for k in ("content", "menu"))
    found = blocks(page)
    model = Labeller.load()
    x = vectors(found)[None].astype(np.float64)
    whole = model.scores(x, np.ones((1, len(found)), bool))[0]
    assert np.allclose(model.long_scores(found, 64), whole, atol=1e-6)
    assert (model.label([found], long=10)[0] == model.label([found])[0]).all()


def test_memory_of_very_many_blocks():
    import subprocess
    import sys

    code = (
        "import resource\nfrom lexilink.llm.htmltext import main_texts\nfrom lexilink.llm.blocklabel import Labeller\nm = Labeller.load()\nmain_texts(['<p>a'], m)\n"
        "a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nmain_texts(['<p>a' * 100_000], m)\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024)"
    )
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 110  # MB: about 1 KB a block, less than a third of what whole matrices took
