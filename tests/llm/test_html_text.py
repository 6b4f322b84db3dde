import pytest

from terrakiln.llm import html_pages
from terrakiln.llm import html_text as H

ARTICLE = "<article><h1>A title of this</h1><p>First &amp; <b>bold</b>\n  text, with a <a href=/x>link</a> in it.<p>Second<br>one goes on for some words.</p><ul><li>An item<li>Another item</ul></article>"
TEXT = "A title of this\nFirst & bold text, with a link in it.\nSecond one goes on for some words.\nAn item\nAnother item"
AROUND = [
    ("<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav>", "<footer>&copy; site, all rights reserved</footer>"),
    ('<header><h2>The site</h2></header><div class="ad">Buy this now, it is cheap.</div>', '<aside class="sidebar"><h3>More</h3><p>Other things to read.</p></aside>'),
    ('<div id="cookie-notice"><p>We use cookies on this site.</p></div>', '<section class="comments"><h3>2 comments</h3><div class="comment"><p>I liked this a lot.</p></div></section>'),
    ("<!-- a comment --><form action=/s><label>Search</label><input name=q></form>", "<script>var a = '</p>';</script><style>p{}</style>"),
]


@pytest.mark.parametrize(("before", "after"), AROUND)
@pytest.mark.parametrize("end", ["</body></html>", ""])
def test_parts_around_the_article_go(before, after, end):
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{before}{ARTICLE}{after}{end}"
    assert H.extract([page], H.model()) == [TEXT]


def test_unseen_layouts():
    kept = missed = extra = 0
    for page, marks in html_pages.generate(120, seed=99):
        text = H.extract([page], H.model())[0]
        found = {m for m in marks if m in text}
        kept, missed = kept + len(found), missed + len(marks) - len(found)
        extra += sum(not any(m in line for m in marks) for line in text.split("\n"))
    assert missed <= 0.01 * kept
    assert extra <= 0.03 * kept


def test_choices_do_not_contradict():
    root = H.Node("#root", None)
    menu = H.Node("div", root)
    leaf = H.Node("#text", menu)
    other = H.Node("#text", root)
    leaf.text, other.text = "menu", "text"
    import numpy as np

    assert H.decode([root, menu, leaf, other], np.array([3.0, -5.0, 2.0, 1.0])) == ["text"]
    assert H.decode([root, menu, leaf, other], np.array([3.0, -1.0, 4.0, 1.0])) == ["menu", "text"]


def texts(page):
    return [leaf.text for leaf, _, _ in H.read(page)[1]]


def test_quotes_outside_values_end_no_tag():
    page = "<p title=it's>Body text one, do not <b>lose</b> it. Don't.</p><p>next</p>"
    assert texts(page) == ["Body text one, do not lose it. Don't.", "next"]
    assert texts("<p class='a' data-x=\"b > c\" o'clock>one's</p><p a=\"b>two \"three\" four</p>") [0] == "one's"
    assert texts("<a href=/x/>a</a> <img src=y alt='>'>b<p/>c") == ["a b", "c"]


def test_styles_that_hide():
    none = H._KIND_OF["none"]
    assert H._kinds(' style="color:red; display : none"') & none
    assert H._kinds(" style='visibility:hidden'") & none
    assert not H._kinds(' style="text-decoration:none"') & none
    assert not H._kinds(' data-style="display:none" title="hidden class=ad"')


def test_text_behind_deep_nesting_hangs_where_it_stands():
    page = "<div>" * 250 + "in" + "</div>" * 60 + "out" + "</x></span>" * 10 + "</div>" * 190 + "end"
    leaves = [leaf for leaf, _, _ in H.read(page)[1]]
    assert [(leaf.text, leaf.depth) for leaf in leaves] == [("in", 251), ("out", 191), ("end", 1)]


def test_decoding_against_all_choices():
    """On small trees: the best of all choices in which nothing is kept inside a dropped node."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(7)
    for _ in range(40):
        nodes = [H.Node("#root", None)]
        for i in range(8):
            nodes.append(H.Node("div", nodes[rng.integers(0, len(nodes))]))
            nodes[-1].text = f"t{i}"
        order, todo = [], [nodes[0]]
        while todo:
            n = todo.pop()
            order.append(n)
            todo.extend(reversed(n.children))
        odds = rng.normal(0, 3, len(order))
        gain = {id(n): (-np.logaddexp(0, -o), -np.logaddexp(0, o)) for n, o in zip(order, odds, strict=True)}
        best, kept = -np.inf, None
        for choice in itertools.product([True, False], repeat=len(order)):
            on = {id(n): c for n, c in zip(order, choice, strict=True)}
            if all(n.parent is None or on[id(n.parent)] or not on[id(n)] for n in order):
                value = sum(gain[id(n)][0 if on[id(n)] else 1] for n in order)
                if value > best:
                    best, kept = value, [n.text for n in order if on[id(n)] and n.text is not None]
        assert H.decode(order, odds) == kept


def test_scores_against_a_walk_of_each_tree():
    import numpy as np

    pages = [page for page, _ in html_pages.generate(3, seed=5)]
    x = np.concatenate([H.features(*H.read(p))[1] for p in pages])
    expected = []
    for row in x:
        total = 0.0
        for feature, cut, value in H.model().trees:
            at = 0
            for _ in range(H.DEPTH):
                at = 2 * at + 1 + (row[feature[at]] > cut[at])
            total += value[at - (2**H.DEPTH - 1)]
        expected.append(total)
    assert np.allclose(H.model().score(x), expected)


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "words" + "</div>" * 3000
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, None, "no tags at all", "x"), (4, "u", "<p>&lt;unclosed <b>x", "x"), (5, "u", deep, "x"), (6, "u", "<article><p>" + "long text. " * 50_000, "x"), (None, "u", "<", "x"), (6, "u", "<a <b> 'c\"", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract_pages(df).collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got if r.page_id in (1, 2)}
    assert by == {1: "", 2: ""}
    assert max(r.n_chars for r in got) == 50_000 * 11 - 1
    assert H.extract_pages(df.limit(0)).count() == 0
