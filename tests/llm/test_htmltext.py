import html
import random

import pytest

from sluice.llm import htmltext

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav></header>
<div class="cookie-notice">We use cookies, accept them now please, all of them.</div>
{main}<div class="sidebar"><p>Popular</p><ul><li><a>one</a><li><a>two</a></ul></div>
<section id="comments"><p>Great post! I really loved reading this, a long comment text.</p></section>
<footer>&copy; me <a href=z>imprint</a></footer></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div id=wrap><div class=post>{}</div></div>",
                                  "<div class='article-content'>{}</div>"])
def test_article_of_generated_pages(wrap):
    rng = random.Random(wrap)
    for _ in range(20):
        paras = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(8, 60))) + " & <é>" for _ in range(rng.randint(2, 9))]
        body = "<h1>The   title</h1>" + "".join(
            f"<p>{'<b>' if rng.random() < .3 else ''}{html.escape(p).replace(' ', rng.choice([' ', chr(10), '  ']), 2)}" for p in paras)
        assert htmltext.main_text(PAGE.format(main=wrap.format(body))) == "\n".join(["The title", *paras])


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain text only", "plain text only"), ("<p>a<p>b", "a\nb"), ("<script>x</script>", ""),
    ("<article><header><h1>T</h1></header><p>x</p><aside>no</aside><form>f</form><p>y&nbsp;&#228;</p></article>", "T\nx\ny ä"),
    ("<article>one<br>two<ul><li>a<li>b</ul>three</article>", "one two\na\nb\nthree"),
    ("<main><section><h2>A</h2><p>aaa bbb</p></section><section><h2>B</h2><p>ccc ddd eee</p></section></main>", "A\naaa bbb\nB\nccc ddd eee"),
    ("<article><p>cut of &am", "cut of &am"), ("<div>" * 3000 + "deep", "deep"),
])
def test_single_pages(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize("page", ["<![bad<p>x</p>", "<p", "</", "<!--", "<!doctype", "<a href='", "&#xD800;&#0;", "\x00<p>\x00"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(htmltext.main_text(page), str)


NOISY = ["<div class='ad-slot'>{}</div>", "<div id=footer>{}</div>", "<div class='post-comments'>{}</div>",
         "<div class=comment-body>{}</div>", "<article class=comment><p>{}</p></article>", "<div role=navigation>{}</div>",
         "<div class='widget related-posts'><h3>Read on</h3><p>{}</p></div>", "<p class=notice>{}</p>", "<div class='entry-footer'>{}</div>",
         "<div class=siteHeader>{}</div>", "<form><label>{}</label></form>", "<noscript>{}</noscript>", "<aside>{}</aside>",
         "<section aria-label='Reader comments'><p>{}</p></section>", "<div class='newsletter-signup'>{}</div>", "<div hidden>{}</div>"]


@pytest.mark.parametrize("noise", NOISY)
@pytest.mark.parametrize("page", [
    "<body>{n}<article><h1>Title</h1><p>{a}</p>{n}<p>{b}</p></article>{n}</body>",
    "<body class=page-with-sidebar><div class='has-sidebar wrap'>{n}<div class=content><h1>Title</h1><p>{a}</p>{n}<p>{b}</p></div></div>{n}</body>",
    "<body>{n}<main><div class=article-header><h1>Title</h1></div><p>{a}</p><p>{b}</p>{n}</main></body>"])
def test_noise_by_name_and_element(page, noise):
    a, b = ("word " * 30).strip() + ".", ("other " * 25).strip() + "."
    n = noise.format("Some longer text that must never show up in the article, however dense it is. " * 3)
    assert htmltext.main_text(page.format(n=n, a=a, b=b)) == f"Title\n{a}\n{b}"


PARAGRAPHS = "<p>" + "word " * 40 + "</p><p>" + "other " * 30 + "</p>"
PARAGRAPH_TEXT = "\n".join([("word " * 40).strip(), ("other " * 30).strip()])


@pytest.mark.parametrize("page", [
    "<html><head><title>t</title><meta charset=utf-8><body><div>{}</div></body></html>",
    "<html><head><title>t</title><script>x</script><div>{}</div></html>",
    "<head><title>t</title><noscript><p>Switch it on</p></noscript><body>{}",
    "<head><title>t</title><img src=x></head><body><article>{}</article></body>",
    "<body><form id=form1 method=post><input type=hidden value=x><div>{}</div><select><option>no</select></form></body>",
    "<body><form id=aspnetForm><div><main>{}</main></div></form></body>",
    "<body><form class=form><nav><a>no</a></nav><div>{}</div><footer>no</footer></form><form class=search><label>no</label></form></body>"])
def test_open_head_and_page_in_a_form(page):
    assert htmltext.main_text(page.format(PARAGRAPHS)) == PARAGRAPH_TEXT


LINKS = "<ul>" + "".join(f"<li><a href=x>Another page {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize("page", [
    "<body><main><article><h2>One</h2>{a}</article><article><h2>Two</h2>{b}</article></main></body>",
    "<body><main><div><article><h2>One</h2>{a}</article></div><div><article><h2>Two</h2>{b}</article></div></main></body>",
    "<body><article><h2>One</h2>{a}</article><article><h2>Two</h2>{b}</article><div>{l}</div></body>",
    "<body><main><h2>One</h2>{a}<div>{l}</div><h2>Two</h2>{b}{l}</main></body>",
    "<body><article><h2>One</h2>{a}<div>{l}</div><h2>Two</h2>{b}</article><article>{l}</article></body>",
    "<body><div><div><h2>One</h2>{a}<h2>Two</h2>{b}</div></div><div>{l}</div></body>"])
def test_several_articles_and_unnamed_link_lists(page):
    b = "<p>" + "third " * 20 + "</p>"
    assert htmltext.main_text(page.format(a=PARAGRAPHS, b=b, l=LINKS)) == f"One\n{PARAGRAPH_TEXT}\nTwo\n{('third ' * 20).strip()}"


def test_links_inside_a_paragraph_stay():
    page = "<main><h1>T</h1><p>See <a>the long first reference</a>.</p>" + PARAGRAPHS + "</main>"
    assert htmltext.main_text(page) == f"T\nSee the long first reference.\n{PARAGRAPH_TEXT}"


def test_text_ends_the_head():
    assert htmltext.main_text("<head><title>t</title>hello <b>world</b>") == "hello world"


def test_density_prefers_text_to_links():
    body = htmltext.parse("<body><div><a>l1 l1</a><a>l2 l2</a><a>l3 l3</a></div><div><p>" + "word " * 50 + "</p></div></body>")
    htmltext.measure(body)
    links, text = body.children[0].children
    assert text.density > links.density and text.total > links.total


def test_extract(spark):
    rows = [(1, "u", PAGE.format(main="<article><p>hello wörld</article>"), "x"), (1, "u", None, "x"), (None, None, "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract(pages).collect()
    assert [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got] == \
        [(1, "u", "hello wörld", 11), (1, "u", "", 0), (None, None, "", 0)]
    assert htmltext.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("part", ['<section id="related-work">{}</section>', '<section class="legal-history">{}</section>',
                                  '<div class="search-results">{}</div>', '<div id="share-prices">{}</div>'])
@pytest.mark.parametrize("page", ["<article><h1>T</h1>{a}{x}</article>", "<main><h1>T</h1>{a}{x}</main>"])
def test_parts_about_a_subject_stay(page, part):
    x = part.format("<p>" + "subject " * 25 + "</p>")
    assert htmltext.main_text(page.format(a=PARAGRAPHS, x=x)) == f"T\n{PARAGRAPH_TEXT}\n{('subject ' * 25).strip()}"
    links = part.format("<p>" + "<a href=x>another subject</a> " * 9 + "</p>")
    assert htmltext.main_text(page.format(a=PARAGRAPHS, x=links)) == f"T\n{PARAGRAPH_TEXT}"


def test_button_in_running_text():
    page = "<article><p>Press the <button>Save</button> button to " + "word " * 20 + "</p>" + PARAGRAPHS + "<button>Send</button></article>"
    assert htmltext.main_text(page) == f"Press the Save button to {('word ' * 20).strip()}\n{PARAGRAPH_TEXT}"


def test_nested_noise_names_are_linear():
    import time

    def seconds(n):
        page = "<div class=sidebar>" * n + "<article><p>" + "word " * 30 + "</p></article>"
        began = time.perf_counter()
        assert htmltext.main_text(page) == ("word " * 30).strip()
        return time.perf_counter() - began
    seconds(500)
    assert min(seconds(8000) for _ in range(3)) < 8 * max(0.02, min(seconds(2000) for _ in range(3)))


def plain_densities(node):
    """The definitions, by recursion over every subtree."""
    import math

    def text(n):
        return sum(len("".join(c.split())) if isinstance(c, str) else text(c) for c in n.children)

    def below(n):
        return [x for c in n.children if not isinstance(c, str) for x in [c, *below(c)]]

    def outer_links(n):
        return [x for c in n.children if not isinstance(c, str) for x in ([c] if c.tag == "a" else outer_links(c))]

    def density(n):
        c, t = text(n), max(1, len(below(n)))
        if not c:
            return 0.0
        if n.tag == "a":
            lc, lt = c, len(below(n))
        else:
            links = outer_links(n)
            lc, lt = sum(map(text, links)), sum(1 + len(below(x)) for x in links)
        whole = (text(node) if node.tag == "a" else sum(map(text, outer_links(node)))) / text(node)
        base = math.log(c / max(1, c - lc) * lc + whole * c + math.e)
        return c / t * max(0.0, math.log(max(1e-9, c / max(1, lc) * t / max(1, lt))) / (1 + math.log(base)))
    out = {}
    for n in [node, *below(node)]:
        own = sum(len(c.strip()) for c in n.children if isinstance(c, str))
        out[n] = (density(n), sum(density(c) for c in n.children if not isinstance(c, str)) + own / max(1, len(below(n))))
    return out


def test_densities_against_plain_recursion():
    rng = random.Random(12)

    def tree(depth):
        kind = rng.random()
        if depth > 4 or kind < 0.3:
            return " ".join(rng.choices(["word", "a", "é", ""], k=rng.randint(0, 12)))
        tag = rng.choice(["div", "p", "a", "b", "ul", "section"])
        return f"<{tag}>" + "".join(tree(depth + 1) for _ in range(rng.randint(0, 5))) + f"</{tag}>"
    for _ in range(60):
        body = htmltext.parse("<body>" + "".join(tree(0) for _ in range(4)) + "some text</body>").children[0]
        htmltext.measure(body)
        for node, (density, total) in plain_densities(body).items():
            assert node.density == pytest.approx(density, rel=1e-9) and node.total == pytest.approx(total, rel=1e-9)


def test_pages_without_article_elements():
    """The same texts when the pages' article and main elements are plain divs: the densities find them."""
    import os
    import re

    import pyarrow.parquet as pq
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("driver test data not present")
    for page in pq.read_table(path).column("html").to_pylist():
        plain = re.sub(r"<(/?)(article|main)\b", r"<\1div", page or "")
        assert htmltext.main_text(plain) == htmltext.main_text(page)
