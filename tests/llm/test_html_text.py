import html
import random
import re
import time

import pytest

from siftspark.llm.common import table
from siftspark.llm.html_text import main_text, nearest, op8_html

PROSE = "This is the first line of a story that is told in the way that stories are."


def expected(page):
    """For the regular pages of the tables: the texts between the block tags of the article."""
    body = page.split("<article>", 1)[1].split("</article>", 1)[0] if "<article>" in page else ""
    parts = re.split(r"</?(?:h1|p)>", body)
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " "))).strip() for p in parts)
    return "\n".join(t for t in texts if t)


def test_pages(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in op8_html(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        text = expected(r.html)
        assert got[r.page_id] == (r.url, text, len(text))


def test_nearest_label_against_all_distances():
    rnd = random.Random(4)
    for n in (0, 1, 2, 5, 40, 90):
        for share in (0.0, 0.05, 0.5, 1.0):
            labels = [rnd.random() < 0.5 if rnd.random() < share else None for _ in range(n)]
            decided = [i for i, x in enumerate(labels) if x is not None]
            want = [x if x is not None or not decided else labels[min(decided, key=lambda j: (abs(j - i), j < i))] for i, x in enumerate(labels)]
            assert nearest(labels) == want


def test_many_blocks_take_linear_time():
    began = time.perf_counter()
    page = "<article>" + "<p>short</p>" * 50_000 + f"<p>{PROSE}</p>" + "<p>short</p>" * 50_000 + "</article>"
    assert main_text(page).count("\n") == 100_000
    assert time.perf_counter() - began < 15


@pytest.mark.parametrize("name", ["share-price", "social-history", "search-results-study", "related-work", "discussion", "adventure", "social", "warning"])
def test_prose_under_names_like_marks_stays(name):
    assert main_text(f"<article><p>{PROSE}</p><div class='{name}'>{PROSE} More.</div></article>") == f"{PROSE}\n{PROSE} More."


@pytest.mark.parametrize("name", ["ad", "ad-banner", "cookie-notice", "newsletter", "sidebar_left", "comments-area", "site-nav", "promo2"])
def test_marked_blocks_go_even_with_prose(name):
    assert main_text(f"<article><p>{PROSE}</p><div class='x {name}'>{PROSE} More.</div><p>{PROSE}</p></article>") == f"{PROSE}\n{PROSE}"


def test_weak_marks_need_looks_inside_an_article_only():
    assert main_text(f"<article><p>{PROSE}</p><div class='share-buttons'>Tweet this</div></article>") == PROSE
    assert main_text(f"<p>{PROSE}</p><div class='related-posts'>{PROSE} More.</div>") == PROSE


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain text that is not marked up at all", "plain text that is not marked up at all"),
        (f"<p>{PROSE}<p>Short.<div class='ad'>Buy the best of the things that are for sale in the town.</div>", f"{PROSE}\nShort."),
        (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{PROSE}</p><footer>By me</footer></article>", f"Title\n{PROSE}"),
        (f"<article><h1>Head &amp; &#8364; &eacute;</h1><p>a<b>b</b>\n c <br> d</p><p>{PROSE}</p></article>", f"Head & € é\nab c d\n{PROSE}"),
        (f"<main><p>{PROSE}</p><div id='comments'><article><p>{PROSE} I like it.</p></article></div></main>", PROSE),
        (f"<article><p>{PROSE}</p></article><article class='comment'><p>{PROSE} No.</p></article>", PROSE),
        (f"<article><p>{PROSE}</p><script>if (a < b) document.write('<p>x</p>')</script><style>p{{}}</style><p>End", f"{PROSE}\nEnd"),
        (f"<article><p>{PROSE}</p><ul><li><a href=x>more</a></li><li><a href='a>b'>of this</a></li></ul></article>", PROSE),
        (f"<article><p>{PROSE}</p><!-- <p>gone</p> --><aside>Side</aside><form><label>Name</label></form><p hidden>no</p></article>", PROSE),
        (f"<div class='site-header'>Top of the page for the people of the town who are in</div><p>{PROSE}</p><div role=navigation>Home</div><div class='cookie-notice'>{PROSE}</div>", PROSE),
        (f"<article><p>{PROSE}</p><p>cut &am", f"{PROSE}\ncut &am"),
        (f"<article><p>{PROSE}</p><footer cla", PROSE),
        (f"<article><p>{PROSE}</p><a title=\"broken>x</a><p>after</p></article>", f"{PROSE}\nx\nafter"),
        ("<ul><li><a>one</a></li></ul><footer>two</footer>", ""),
        ("<article>" + f"<p>{PROSE}</p>" * 5000, "\n".join([PROSE] * 5000)),
    ],
)
def test_cases(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<html><head><title>T</title><meta charset=utf-8><body><p>{PROSE}</p>", PROSE),
        (f"<html><head><title>T</title><p>{PROSE}", PROSE),
        (f"<head><title>T</title>{PROSE}", PROSE),
        (f"<article><ul><li class=ad>{PROSE} Buy.<li>{PROSE}</ul><p>{PROSE}</article>", f"{PROSE}\n{PROSE}"),
        (f"<article><ul><li class=ad><div>{PROSE} Buy.</div><ul><li>{PROSE} In.</ul><li>{PROSE}</ul></article>", PROSE),
        (f"<table><tr><td class=sidebar>{PROSE} Side.<td>{PROSE}<tr class=ad><td>{PROSE} Ad.<tr><td>{PROSE}</table>", f"{PROSE}\n{PROSE}"),
        (f"<table><thead class=nav><tr><th>{PROSE} Head.<tbody><tr><td>{PROSE}</table>", PROSE),
        (f"<dl><dt class=ad>{PROSE} Ad.<dd>{PROSE}<dt>{PROSE}</dl>", f"{PROSE}\n{PROSE}"),
        (f"<p class=ad>{PROSE} Ad.<div>{PROSE}</div>", PROSE),
        (f"<div class=ad><table><tr><td>{PROSE} Ad.</div>{PROSE} Ad.</table></div><p>{PROSE}", PROSE),
        (f"<form action=x><nav>Home</nav><article><p>{PROSE}</p></article></form>", PROSE),
        (f"<form id=all><header>Top</header><div><p>{PROSE}</p></div><footer>End</footer></form>", PROSE),
        (f"<article><p>{PROSE}</p><form><p>{PROSE} Sign up.</p><select><option>a<option>b</select></form></article>", PROSE),
        (f"<form><article><p>{PROSE}</p><div class=ad>{PROSE} Ad.</div></article></form>", PROSE),
    ],
)
def test_end_tags_left_out_and_forms_around_pages(page, text):
    assert main_text(page) == text


#: What may stand in what; a leaf is a paragraph of prose. For pages whose text a walk over their tree gives.
INSIDE = {"body": ["div", "ul", "dl", "table", "section", "p"], "div": ["ul", "dl", "table", "p", "div"], "section": ["ul", "p", "table", "dl"], "ul": ["li"], "li": ["p", "ul", "div", "text"], "dl": ["dt", "dd"], "dt": ["text"], "dd": ["p", "ul", "text"], "table": ["tbody"], "tbody": ["tr"], "tr": ["td", "th"], "td": ["p", "ul", "table", "text"], "th": ["text"], "p": ["text"]}
MAY_BE_LEFT_OUT = {"li", "dt", "dd", "tbody", "tr", "td", "th", "p", "body", "head", "html"}


def tree(rnd, name, depth=0):
    if name == "text":
        return f"{PROSE} Number {rnd.randint(0, 10**6)}."
    marked = name != "body" and rnd.random() < 0.15
    inside = [k for k in INSIDE[name] if depth < 7 or k not in ("ul", "dl", "table", "div")] or ["text"]
    return name, marked, [tree(rnd, rnd.choice(inside), depth + 1) for _ in range(1 if inside == ["text"] else rnd.randint(1, 4))]


def written(node, leave_out, last=True):
    if isinstance(node, str):
        return node
    name, marked, inside = node
    # text between two blocks would join the first one, if that ends only where the text does: items of text are alone in their element
    parts = "".join(written(c, leave_out, i == len(inside) - 1) for i, c in enumerate(inside))
    end = "" if leave_out and name in MAY_BE_LEFT_OUT else f"</{name}>"
    return f"<{name}{' class=sidebar' if marked else ''}>{parts}{end}"


def walked(node):
    if isinstance(node, str):
        return [node]
    return [] if node[1] else [t for c in node[2] for t in walked(c)]


def alone(node):
    """The tree with text only where nothing stands beside it."""
    if isinstance(node, str):
        return node
    name, marked, inside = node
    if len(inside) > 1:
        inside = [c if not isinstance(c, str) else ("p", False, [c]) for c in inside]
    if name == "dt":
        inside = inside[:1]
    return name, marked, [alone(c) for c in inside]


def test_pages_give_what_a_walk_over_their_tree_gives_with_and_without_optional_end_tags():
    rnd = random.Random(9)
    for _ in range(400):
        body = alone(tree(rnd, "body"))
        want = "\n".join(walked(body))
        for leave_out in (False, True):
            head = "<html><head><title>T</title>" + ("" if leave_out else "</head>")
            page = head + written(body, leave_out)
            assert main_text(page) == want, page


def test_rows_that_repeat_and_clash(spark):
    rows = [(1, "u", f"<p>{PROSE}</p>", "t"), (1, "u", f"<p>{PROSE}</p>", "t"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((tuple(r) for r in op8_html(df).collect()), key=str) == sorted([(1, "u", PROSE, len(PROSE))] * 2 + [(None, None, "", 0)], key=str)
    assert op8_html(df.limit(0)).collect() == []
