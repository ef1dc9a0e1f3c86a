import pytest

from casework.llm.html_text import blocks, extract, main_text

LONG = "The river runs to the sea and it is the place that all of the people of the town go to in the summer. "
SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def article(body, before="", after=""):
    return f"<html><head><title>T</title></head><body>{before}<article>{body}</article>{after}</body></html>"


@pytest.mark.parametrize("page, expected", [
    (None, ""),
    ("", ""),
    ("plain words", "plain words"),
    (article(f"<h1>A</h1><p>{LONG}<p>Short.<p>{LONG}"), f"A\n\n{LONG.strip()}\n\nShort.\n\n{LONG.strip()}"),
    (article("<h1>Only</h1><p>Tiny."), "Only\n\nTiny."),
    (article(LONG, f"<nav><a href=x>{LONG}</a></nav><header>{LONG}</header><div class='cookie-notice'>{LONG}</div>",
             f"<div id=comments><p>{LONG}</div><aside>{LONG}</aside><footer>{LONG}</footer><p>{LONG}"), LONG.strip()),
    (article(f"<p>{LONG}</p><div class='ad'>{LONG}</div><form><p>{LONG}</form><p><a href=x>{LONG}</a></p><p>end"),
     f"{LONG.strip()}\n\nend"),
    (article("a &amp; b&nbsp;&lt;c&gt; &#233;\t\n x<br>y <b>z</b>!<script>if (a<b) '</p>'</script><!-- <p>no -->"), "a & b <c> é x y z!"),
    (article("1 < 2 and 3 > 2 <3"), "1 < 2 and 3 > 2 <3"),
    (article("<p title='a > b' data-x=\"<\">t <p>u"), "t\n\nu"),
    (f"<div class='with-sidebar'><h2>Head</h2><p>{LONG}</p><p>Ok.</p></div><div class=sidebar><p>{LONG}</div><ul><li><a>x</a><li><a>y</a></ul>",
     f"Head\n\n{LONG.strip()}\n\nOk."),
    (f"<p>{LONG}</p><p hidden>{LONG}</p><p>k</p><div style='display: none'>{LONG}</div><section role=search>{LONG}</section>",
     f"{LONG.strip()}\n\n{LONG.strip()}\n\nk"),
    (f"<article class=post>{LONG}<section class='comments'><article class=comment>{LONG}</article></section></article>", LONG.strip()),
    ("<p>a<br><br>b", "a\n\nb"),
    ("<script>x", ""),
    ("<style>p{}</style><textarea>t</textarea>ok", "ok"),
])
def test_main_text(page, expected):
    assert main_text(page) == expected


@pytest.mark.parametrize("value", ["a > b " * 1000, "<i>x</i> " * 1000, '{"class": "menu"} hidden id="nav" ' * 300])
def test_long_attribute_values_are_no_text(value):
    assert main_text(article(f"<p data-state='{value}'>{LONG}</p>")) == LONG.strip()
    assert main_text(f"<div class=menu data-state='{value}'><p>{LONG}</div><p>{LONG}x") == f"{LONG}x"


def test_a_stray_quote_does_not_swallow_the_page():
    assert main_text(article(f'<p width=5">{LONG * 50}</p><p title="t">{LONG}')) == f"{(LONG * 50).strip()}\n\n{LONG.strip()}"


def test_many_open_values_are_quick():
    for unit in ("<a '", '<a "="', "<a ='x\"", '<a "\'"', "<a = '"):
        assert main_text(unit * 30000 + ">") is not None


def test_a_small_article_does_not_hide_the_page():
    page = f"<article><h3>Teaser</h3><p>{LONG}</article><div><h1>Head</h1><p>{LONG}<p>Short.<p>{LONG}</div><ul><li><a>x</a></ul>"
    assert main_text(page) == f"Teaser\n\n{LONG.strip()}\n\nHead\n\n{LONG.strip()}\n\nShort.\n\n{LONG.strip()}"
    assert main_text(f"<p>{LONG}<article><p>{LONG}<p>{LONG}</article>") == f"{LONG.strip()}\n\n{LONG.strip()}"


def test_ambiguous_blocks_follow_the_nearest_decided_one():
    page = f"<div><p>{LONG}<p>near text<p>also near</div><p>far<p>close to links<p><a>{LONG}</a>"
    assert main_text(page) == f"{LONG.strip()}\n\nnear text\n\nalso near"


def test_long_and_broken_pages_are_quick():
    assert main_text("<p>" * 100000 + "x") == "x"
    assert main_text("<a '" * 50000) != ""
    assert main_text("<div>" * 20000 + LONG) == LONG.strip()
    assert len(main_text(article(LONG * 20000))) == len(LONG) * 20000 - 1
    assert blocks("<" * 100000)


def test_rows(spark):
    rows = [(1, "u", article(LONG), "x", 1), (1, "u", article(LONG), "x", 1), (None, None, None, "x", 1), (2, "v", "", None, None)]
    out = extract(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    text = LONG.strip()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(
        [(1, "u", text, len(text)), (1, "u", text, len(text)), (None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0
