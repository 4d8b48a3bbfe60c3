"""The tolerant tree, content scoring against a plain recursion, and result pages with loose markup."""

import random

import pytest

from pressmill.functions import htmltree as ht
from pressmill.sources.html_results import parse_result_page


def shape(node):
    return [c.strip() if isinstance(c, str) else (c.tag, shape(c)) for c in node.children if not isinstance(c, str) or c.strip()]


@pytest.mark.parametrize("html,want", [
    ("<p>a<p>b", [("p", ["a"]), ("p", ["b"])]),
    ("<p><b>a<br><div>c</div>d", [("p", [("b", ["a", ("br", [])])]), ("div", ["c"]), "d"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", [("ul", [("li", ["a"]), ("li", ["b", ("ul", [("li", ["c"])])]), ("li", ["d"])])]),
    ("<table><tr><td>a<td>b</p></table>c", [("table", [("tr", [("td", ["a"]), ("td", ["b"])])]), "c"]),
    ("<div><table><tr><td>x</div>y</table>z</div>", [("div", [("table", [("tr", [("td", ["x", "y"])])]), "z"])]),
    ("<a name=x>l<a href=y>m</a>n", [("a", ["l"]), ("a", ["m"]), "n"]),
    ("</i></div>x<dl><dt>a<dd>b<dt>c</dl>", ["x", ("dl", [("dt", ["a"]), ("dd", ["b"]), ("dt", ["c"])])]),
    ("<select><option>1<option>2</select>", [("select", [("option", ["1"]), ("option", ["2"])])]),
])
def test_implied_ends(html, want):
    assert shape(ht.parse(html)) == want


@pytest.mark.parametrize("junk", ["", "<", "</", "<!", "<a", "&", "&#", "&#x110000;", "<![CDATA[x", "<![foo[bar]]>", "<![if x]>y<![endif]>",
                                  "<!-- ", "<script>x", "<div/><p>", "\x00<p", "<?php", "<!DOCTYPE", "<p a=\"", "<b" * 5_000, "<div>" * 20_000])
def test_any_input_gives_a_tree(junk):
    root = ht.parse(junk)
    assert root.text() is not None and ht.content_html(junk) is not False


def test_slices_give_back_the_source():
    html = "<body><div id=1>\n<p>a<p>b</div><img src=x>\n<section><h1>t</h1>u</section></body>"
    by_tag = {n.tag: n for n in ht.parse(html).nodes()}
    assert html[by_tag["div"].inner_begin:by_tag["div"].inner_end] == "\n<p>a<p>b"
    assert html[by_tag["section"].begin:by_tag["section"].end] == "<section><h1>t</h1>u</section>"
    assert html[by_tag["p"].begin:by_tag["p"].end] == "<p>b"


def plain_scores(root):
    """The same rules, top down and without sharing anything."""
    def shown(n):
        return [n2 for n2 in n.children if isinstance(n2, str) or not ht.passed_over(n2)]

    def measure(n):
        size = link = commas = 0
        for c in shown(n):
            if isinstance(c, str):
                size, commas = size + len(" ".join(c.split())), commas + c.count(",")
            else:
                s, k, m = measure(c)
                size, link, commas = size + s, link + k, commas + m
        return size, size if n.tag == "a" else link, commas

    def blocks(n):
        return any(not isinstance(c, str) and (c.tag in ht.BLOCKS or blocks(c)) for c in shown(n))

    raised = {}
    def visit(n):
        if n.tag in ht.PARAGRAPHS or (n.tag in ht.LOOSE and not blocks(n)):
            size, _, commas = measure(n)
            worth = 1 + commas + min(size / 100, 3) if size >= 25 else 0
            heirs = [(n.parent, 1.0), (n.parent.parent if n.parent else None, 0.5)] + ([(n, 1.0)] if n.tag in ht.LOOSE else [])
            for heir, share in heirs:
                if worth and heir is not None and heir.parent is not None:
                    raised[heir.number] = raised.get(heir.number, 0) + share * worth
        for c in shown(n):
            if not isinstance(c, str):
                visit(c)
    visit(root)
    out = {}
    for n in root.nodes():
        if n.number in raised:
            size, link, _ = measure(n)
            out[n.number] = (ht.BASE_SCORES.get(n.tag, 0) + ht.weight(n) + raised[n.number]) * (1 - (link / size if size else 0))
    return out


def test_scores_against_plain_recursion():
    rng = random.Random(12)
    tags = ["div", "p", "section", "ul", "li", "a", "span", "b", "td", "nav", "blockquote", "article", "form"]

    def grow(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            if depth == 0 or rng.random() < 0.35:
                out.append(" ".join(rng.choice(["word", "words,", "long-word"]) for _ in range(rng.randint(0, 25))))
            else:
                t = rng.choice(tags)
                cls = rng.choice(["", ' class="post-body"', ' id="sidebar"', ' class="x"'])
                out.append(f"<{t}{cls}>{grow(depth - 1)}</{t}>")
        return "".join(out)

    scored = 0
    for _ in range(300):
        root = ht.parse(f"<html><body>{grow(5)}</body></html>")
        got, want = ht.Scores(root).score, plain_scores(root)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
        scored += len(got)
    assert scored > 1_000


def test_content_is_found_without_an_article_element():
    story = "".join(f"<p>Sentence {i}, with a few commas, and enough words to count as one paragraph." for i in range(4))
    html = (f"<body><div class=menu>{'<a href=/>Home</a> ' * 30}</div><div id=wrap><div class=x>{story}</div>"
            f"<p>One more paragraph beside the story, which is long enough, and has no links at all in its text, so it belongs.</p>"
            f"<div class='comments'>{story}{story}</div></div><footer>{story}</footer></body>")
    got = ht.content_html(html)
    assert got.startswith("<p>Sentence 0") and "belongs" in got and got.count("Sentence") == 4 and "Home" not in got
    assert ht.content_html("<body><div>tiny</div></body>") == "tiny"
    assert ht.content_html("<body><nav>only a menu, of some length, with words</nav></body>") is None


def test_result_pages_with_loose_markup():
    google = ("<div class=g><p>x<a name=top></a><h3><a href='/url?q=http://a/'>A</a></h3><span class=st>one<br>two</span></div>"
              "<div class=g><a href=http://b/>B</a><div class=g><a href=http://c/>C</a><span class=st>three</span></div></div>"
              "<div class=g><span class=st>no link</div>")
    assert parse_result_page("google", google) == [(0, "/url?q=http://a/", "A", "onetwo"), (1, "http://b/", "B", "three"),
                                                    (2, "http://c/", "C", "three"), (3, "", "", "no link")]
    bing = "<ol><li class='b_algo'><h2><a href=http://a/>A</a></h2><p>one<li class='b_algo'><a href=http://b/>B</a><p>two<p>more</ol>"
    assert parse_result_page("bing", bing) == [(0, "http://a/", "A", "one"), (1, "http://b/", "B", "two")]
