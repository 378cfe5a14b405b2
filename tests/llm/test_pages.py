"""Main texts of generated pages with random themes, against the article that each was made of."""

import random

import pytest

from folio.llm import html

WRAPS = ("layout has-sidebar", "page no-comments", "site with-ads form-of-life", "sidebar-wrapper", "")
CONTAINERS = (("article", "post comments-open"), ("article", "hentry"), ("div", "entry-content"), ("main", "alert-free"), ("section", "story-body"), ("td", "content"))
FURNITURE = (
    "<header><h2>{0}</h2></header>", "<nav><ul><li><a href=x>{0}</a></ul></nav>", "<div class='site-header'>{0}</div>", "<div class='cookie-notice'><p>{0}</p></div>", "<aside>{0}</aside>", "<div id=sidebar1><p>{0}</p></div>",
    "<div class='ad-slot wide'>{0}</div>", "<ul class=breadcrumbs><li>{0}</ul>", "<section class='commentList'><article class=comment><p>{0}</p></article></section>", "<form><label>{0}</label><input></form>", "<div class='related-posts'><p>{0}</p></div>",
    "<div class=share-buttons>{0}</div>", "<script>var x='{0}';</script>", "<style>p {{ {0} }}</style>", "<footer>{0}</footer>", "<div role=banner>{0}</div>", "<div style='display: none'>{0}</div>", "<!-- {0} -->", "<p class='newsletter-signup'>{0}</p>",
)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def paragraph(rng):
    """(html, text) of a paragraph."""
    a, b = words(rng, rng.randint(4, 30)), words(rng, 3)
    inner, text = rng.choice(
        [(f"{a}  <b>{b}</b>\n{a}", f"{a} {b} {a}"), (f"{a}<br>{b}", f"{a} {b}"), (f"{a} &amp; &lt;{b}&gt;&nbsp;{b}", f"{a} & <{b}> {b}"), (f"{a} <a href='y'>{b}</a>.", f"{a} {b}."), (f"{a} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>", f"{a} x=2"), (a, a)]
    )
    kind = rng.choice(["<p>{}</p>", "<p>{}", "<p class='alert-free'>{}</p>", "<blockquote>{}</blockquote>", "<ul><li>{}</ul>", "<h3>{}</h3>", "<div class='form-of-life'>{}</div>"])
    return kind.format(inner), " ".join(text.replace("\xa0", " ").split())


def page(rng, theme):
    wrap, (tag, name), before, after = theme
    parts = [paragraph(rng) for _ in range(rng.randint(4, 9))]
    title = words(rng, 4)
    body = [f"<h1>{title}</h1>", *(x for x, _ in parts)]
    for k in rng.sample(range(1, len(body) + 1), 2):
        body.insert(k, rng.choice(FURNITURE).format(words(rng, 6)))
    core = f"<{tag} class='{name}'>{''.join(body)}</{tag}>"
    core = f"<table><tr>{core}</tr></table>" if tag == "td" else core
    around = lambda kinds: "".join(k.format(words(rng, rng.randint(2, 25))) for k in kinds)
    text = f"<html><head><title>{words(rng, 3)}</title></head><body><div class='{wrap}'>{around(before)}{core}{around(after)}</div></body></html>"
    return text, " ".join([title, *(t for _, t in parts)])


def test_articles_of_random_themes(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for host in range(24):
        theme = (rng.choice(WRAPS), rng.choice(CONTAINERS), rng.sample(FURNITURE, rng.randint(0, 4)), rng.sample(FURNITURE, rng.randint(0, 5)))
        for _ in range(8):
            text, want[len(rows)] = page(rng, theme)
            rows.append((len(rows), f"http://h{host}.org/{len(rows)}", text, "x"))
    table = spark.createDataFrame(rows, "page_id long, url string, html string, path string")  # a clashing name
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extracted(table).select("page_id", "text", "n_chars").collect()}
    wrong = [(rows[i][2], got[i][0], t) for i, t in want.items() if got[i] != (t, len(t))]
    assert not wrong, (len(wrong), wrong[0])


def test_ties_go_to_the_smaller_path(spark):
    rows = [(1, "http://h/1", "<div class=b><p>one two three</div>"), (2, "http://h/2", "<div class=a><p>four five six</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html.consensus_paths(pages).first()["path"] == "/div.a"
    assert {r["page_id"]: r["text"] for r in html.extracted(pages).collect()} == {1: "one two three", 2: "four five six"}


@pytest.mark.parametrize(("name", "told"), [("site-header", True), ("commentList", True), ("ad-slot2", True), ("has-sidebar", False), ("comments-open", False), ("alert-free", False), ("form-of-life", False), ("post", False), ("", False)])
def test_names(name, told):
    assert html.names_furniture(name) == told


SENTENCES = "The harbour lay quiet before dawn. Boats rocked against the old stone wall, and nobody spoke of the storm. "


def extracted(spark, *rows):
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(html.extracted(pages).collect(), key=lambda r: r["page_id"])]


@pytest.mark.parametrize("wrap", ["<form runat=server>{}</form>", "<form id=aspnetForm method=post><div class=page>{}</div></form>", "<form><fieldset>{}</fieldset></form>", "<div role=form>{}</div>"])
@pytest.mark.parametrize("head", ["<h1>Harbour</h1>", "<h2>Harbour</h2>"])
def test_a_form_around_the_page(spark, wrap, head):
    if "role" in wrap and "h2" in head:
        head = "<h1>Harbour</h1>"
    body = f"<nav><a href=x>home</a></nav><div class=content>{head}<p>{SENTENCES * 3}</p></div><form><label>your name</label><input></form><footer>imprint</footer>"
    assert extracted(spark, ("http://f/", f"<html><body>{wrap.format(body)}</body></html>")) == [f"Harbour {(SENTENCES * 3).strip()}"]


@pytest.mark.parametrize("name", ["class=discussion", "id=search", "class=related", "id='reply'", "class=sharing", "class=promotion", "id=tags", "class=navigation"])
def test_sections_named_by_what_they_are_about(spark, name):
    page = f"<article><h1>Paper</h1><p>{SENTENCES}</p><section {name}><h2>Of boats</h2><p>{SENTENCES * 2}</p></section><div class='{name.split('=')[1].strip(chr(39))}'><a href=x>one</a> <a href=y>two</a></div></article>"
    assert extracted(spark, ("http://p/", page)) == [f"Paper {SENTENCES.strip()} Of boats {(SENTENCES * 2).strip()}"]


def test_readers_comments_stay_out(spark):
    theirs = f"<section class=discussion><h3>12 comments</h3><p>{SENTENCES * 2}</p></section><section id=reply><h3>Talk</h3><div class=comment><p>{SENTENCES * 2}</p></div></section><div class=comments><h1>What readers say</h1><p>{SENTENCES}</p></div>"
    page = f"<article><h1>Paper</h1><p>{SENTENCES * 3}</p>{theirs}</article>"
    assert extracted(spark, ("http://p/", page)) == [f"Paper {(SENTENCES * 3).strip()}"]


def test_a_label_in_a_sentence(spark):
    assert extracted(spark, ("http://l/", f"<article><p>{SENTENCES} Write <label>your name</label> here.</p></article>")) == [f"{SENTENCES} Write your name here.".replace("  ", " ")]


def test_the_hosts_path_in_another_template(spark):
    usual = [(f"http://t/{k}", f"<div class=content><h1>Page {k}</h1><p>{SENTENCES * 4}</p></div>") for k in range(5)]
    other = ("http://t/x", f"<div class=content>Teaser.</div><article><h1>Other</h1><p>{SENTENCES * 8}</p></article>")
    assert extracted(spark, *usual, other)[-1] == f"Other {(SENTENCES * 8).strip()}"


def test_deep_pages_take_memory_in_proportion():
    import time
    import tracemalloc

    took = []
    for n in (5_000, 40_000):
        text = "<div class='a-long-name of-a-class'>" * n + f"<p>{SENTENCES}" + "</span>" * n
        tracemalloc.start()
        began = time.time()
        page = html.Page(text)
        assert page.main(None) == SENTENCES.strip()
        took.append((tracemalloc.get_traced_memory()[1], time.time() - began))
        tracemalloc.stop()
    assert took[1][0] < 12 * took[0][0] and took[1][0] < 150 << 20 and took[1][1] < 20


def test_articles_with_names_of_their_own_vocabulary(spark):
    """Class names drawn from words that the code has no list of, furniture told by tags alone."""
    rng = random.Random(12)
    rows, want = [], []
    for host in range(10):
        name, side = (f"{words(rng, 1)}-{words(rng, 1)}" for _ in range(2))
        for k in range(4):
            parts = [words(rng, 30) for _ in range(5)]
            rows.append((f"http://v{host}/{k}", f"<body><nav>{words(rng, 8)}</nav><div class='{side}'><ul>{''.join(f'<li><a href=x>{words(rng, 3)}</a>' for _ in range(6))}</ul></div><div class='{name}'><h1>{parts[0]}</h1>{''.join(f'<p>{x}</p>' for x in parts[1:])}</div><footer>{words(rng, 5)}</footer></body>"))
            want.append(" ".join(parts))
    assert extracted(spark, *rows) == want
