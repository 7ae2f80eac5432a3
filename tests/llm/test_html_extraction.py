import pytest

from llm.conftest import long_text
from ticketlens.llm import html_extraction as H

SCHEMA = "page_id bigint, url string, html string, host string, template string, text int"


@pytest.fixture
def pages(spark):
    return lambda *rows: spark.createDataFrame([(*r, "h", "t", 1) for r in rows], SCHEMA).repartition(3)


def page(k, body, side="aside"):
    menu = "".join(f'<li><a href="/{k}{j}">Link {k} {j}</a></li>' for j in range(5))
    return (
        f"<!DOCTYPE html><html><head><title>T {k}</title><script>var x='</p><p>no';</script></head><body>"
        f"<header>Site name</header><nav><ul>{menu}</ul></nav><!-- no {k} --><div class='ad box'>Buy {k} now</div>"
        f"{body}<{side}>Side {k}</{side}><form><p>Mail {k}</p><input name=a></form>"
        f'<div class="comments"><p>First! {k}</p></div><footer>&copy; {k}</footer></body></html>'
    )


def extracted(df):
    return {r.page_id: r.text for r in H.extract_text(df).collect()}


def test_article_of_pages_with_menus_and_the_like(pages):
    rows = [(k, f"https://A.example.org:80/{k}", page(k, f"<article><h1>Head {k}</h1><p>One&amp;{k} <b>bold</b>\n x<br>y</p><p>Two</p></article>")) for k in range(12)]
    got = extracted(pages(*rows))
    assert got == {k: f"Head {k}\nOne&{k} bold x y\nTwo" for k in range(12)}


def test_slots_without_names_and_constant_nodes(pages):
    body = "<div><div><p>{a}</p><p>{b}</p><span>Read more on our site</span></div></div>"
    rows = [(k, "http://b.example.org/x", page(k, body.format(a=long_text(k, 30), b=long_text(k + 50, 20)))) for k in range(12)]
    got = extracted(pages(*rows))
    assert got == {k: f"{long_text(k, 30)}\n{long_text(k + 50, 20)}" for k in range(12)}


def test_unclosed_and_odd_markup(pages):
    rows = [
        (1, "http://c.example.org", "<article><h1>A</h1><p><b>one<br><p>two<ul><li>x<li>y</ul>three &lt;b&gt;</article>"),
        (2, "http://d.example.org", "<p>a < b & c</p><p title='>'>d"),
        (3, None, "plain text"),
        (4, "no address", "<div" + "<div>" * 3_000 + "deep"),
        (5, "http://e.example.org", None),
        (6, "http://e.example.org", ""),
        (7, "http://f.example.org", "<main>" + "<p>w &nbsp; w</p>" * 5_000 + "</main>"),
    ]
    got = extracted(pages(*rows))
    assert got[1] == "A\none\ntwo\nx\ny\nthree <b>"
    assert got[2] == "a < b & c\nd"
    assert got[3] == "plain text" and got[4] == "deep" and got[5] == got[6] == ""
    assert got[7] == "\n".join(["w w"] * 5_000)


def test_result_counts_code_points_and_keeps_rows(pages):
    rows = [(1, "http://g.example.org/1", "<article>é😀</article>")] * 3 + [(None, None, None)]
    got = H.extract_text(pages(*rows)).collect()
    assert sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in got) == [
        *[("1", "http://g.example.org/1", "é😀", 2)] * 3, ("None", None, "", 0)
    ]
    assert H.extract_text(pages(*rows).limit(0)).count() == 0


def test_tree_matching_counts_the_common_tree():
    def tree(source):
        return H.kinds(H.parse(source))

    a, b = tree("<div><ul><li>x</li></ul><p>y</p></div>"), tree("<div><p>y</p><table></table></div>")
    assert H.tree_match(a, a) == 5
    assert H.tree_match(a, b) == 3
    assert [(x and x.label, y and y.label) for x, y in H.aligned(a.children[0].children, b.children[0].children)] == [
        ("ul", None), ("p", "p"), (None, "table")
    ]


def test_templates_stay_small(pages):
    rows = [(k, "http://h.example.org", page(k, "<article>" + "<p>x<i>y</i></p><h2>z</h2>" * (k % 90) + "</article>")) for k in range(200)]
    (only,) = H.host_templates(pages(*rows).selectExpr("'h' AS host", "html")).collect()
    assert len(only.template) < 30_000


def test_copies_do_not_vote_however_they_are_split(pages):
    body = "<article><h1>Same head</h1><p>Same paragraph</p></article>"
    rows = [(k, "http://i.example.org/", page(0, body)) for k in range(60)]
    rows += [(100 + k, "http://i.example.org/", page(k, f"<article><h1>Head {k}</h1><p>Text {k}</p></article>")) for k in range(1, 2)]
    whole, split = (extracted(pages(*rows).repartition(n)) for n in (1, 8))
    assert whole == split
    assert {split[k] for k in range(60)} == {"Same head\nSame paragraph"}
    assert split[101] == "Head 1\nText 1"
