"""Pages written by hand, of kinds that the training pages' generator did not make."""

import pytest
from tilewright.llm import html

NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
FOOT = '<footer><p>&copy; 2024 Example Ltd. All rights reserved.</p></footer>'


def pg(x):
    return f'<!DOCTYPE html><html><head><title>T</title></head><body>{NAV}{x}{FOOT}</body></html>'

L = "The council met on Monday to discuss the new bridge over the river, and most members agreed that it should be built soon."
L2 = "Work may begin next spring, if the money is found, said the mayor, who has long asked for it."


CASES = [
    (pg(f"<article><h1>T</h1><p>{L}</p><p>{L2}</p></article>"),["T",L,L2]),
    (pg(f"<article><h1>Bridge</h1><p>{L}</p><h2>One</h2><p>{L2}</p><h2>Two</h2><p>{L}</p></article>"),["Bridge",L,"One",L2,"Two",L]),
    (pg(f"<article><h1>Bridge</h1><p>{L}</p><table><tr><th>Year</th><th>Cost</th></tr><tr><td>2020</td><td>5</td></tr></table><p>{L2}</p></article>"),["Bridge",L,"Year","Cost","2020","5",L2]),
    (pg(f'<article><h1>Bridge</h1><p>{L}</p><div class="note">Important remark</div><p>{L2}</p></article>'),["Bridge",L,"Important remark",L2]),
    (pg(f'<article><header><h1>Real headline</h1></header><p>{L}</p><p>{L2}</p></article>'),["Real headline",L,L2]),
    (pg(f'<article><h1>Poem</h1><p>line one<br>line two</p><p>{L2}</p></article>'),["Poem","line one","line two",L2]),
    (pg(f'<article><h1>Bridge</h1><p>{L}</p><figure><img src=a.png><figcaption>The old bridge</figcaption></figure></article>'),["Bridge",L,"The old bridge"]),
    (pg(f'<article class="legal-notice"><h1>Terms</h1><p>{L}</p><p>{L2}</p></article>'),["Terms",L,L2]),
    ("<p>Only one line here.</p>",["Only one line here."]),
    (pg("<article><p>A</p><video src=a.mp4><p>B</p><p>C</p></article>"),["A","B","C"]),
    (pg("<article><p>A</p><object data=a><p>B</p><p>C</p></article>"),["A","B","C"]),
    (pg(f"<article><p>Here <math><mi>x</mi></math> is a number.</p><p>{L}</p></article>"),["Here x is a number.",L]),
    (pg(f"<article><h1>S</h1><svg><path d=1><p>{L}</p><select><p>{L2}</p></article>"),["S",L,L2]),
    (pg(f"<main><h1>Guide</h1><p>{L}</p><ul><li>First</li><li>Second</li></ul><p>{L2}</p></main>"),["Guide",L,"First","Second",L2]),
    (pg(f"<div id=content><h1>Guide</h1><p>{L}</p><p>{L2}</p></div><div class=comments><p>Great read!</p><p>I agree</p></div>"),["Guide",L,L2]),
    (pg(f"<article><h1>Guide</h1><p>{L}</p><aside class=ad>Buy now</aside><p>{L2}</p><section class=comments><h3>Comments</h3><p>Nice one</p></section></article>"),["Guide",L,L2]),
    (pg(f"<article><h1>Guide</h1><p>{L}</p><form><label>Name</label><input><select><option>a<option>b</select><button>Go</button></form><p>{L2}</p></article>"),["Guide",L,L2]),
    (f"<body><div class='cookie-banner'><p>We use cookies.</p><button>OK</button></div>{NAV}<h1>Plain</h1><p>{L}</p><p>{L2}</p>{FOOT}</body>",["Plain",L,L2]),
    (pg(f'<div class="sidebar"><h3>Latest</h3><ul><li><a href=/a>One story</a></li><li><a href=/b>Two story</a></li></ul></div><article><p>{L}</p></article>'),[L]),
    (pg(f"<article><h1>Bridge</h1><section><h2>Why</h2><p>{L}</p></section><section><h2>When</h2><p>{L2}</p></section><dl><dt>Bridge</dt><dd>A road over water</dd></dl></article>"),["Bridge","Why",L,"When",L2,"Bridge","A road over water"]),
    ("<html><body><p>One.</p><p>Two.</p></body></html>",["One.","Two."]),
    (pg(f"<article><h1>Code</h1><pre>a = 1</pre><p>{L}</p><blockquote>Said so</blockquote></article>"),["Code","a = 1",L,"Said so"]),
]


@pytest.mark.parametrize("page, told", CASES)
def test_hand_written_page(page, told):
    assert html.extract([page], html.trained()) == ["\n".join(told)]


def test_main_text_equals_the_article_of_all_pages(spark):
    """Pages of the small tables hold one article each, whose blocks are h1, p and br."""
    import html as html_lib
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html.main_texts(rows).join(rows.select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (html_lib.unescape(re.sub(r"<[^>]*>", "", x)) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inside))
        assert r["text"] == "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)
        assert r["n_chars"] == len(r["text"])


def test_ends_of_elements():
    held = html.trained()
    assert html.extract(["<article><p>A<script>var x", "<article><p>A<!-- x"], held) == ["A", "A"]
    nodes, texts = html.parse("<p>a<iframe src=x><p>b<iframe>no frames</iframe><template><p>gone</p></template>c<!--> d")
    assert [t.strip() for _, t, _ in texts] == ["a", "b", "c", "d"] and [x.tag for x in nodes] == ["#page", "p", "p"]


def test_long_page_and_odd_columns(spark):
    page = "<html><body><nav><a href=/>x</a></nav><article>" + "<p>Some words of a long article, one after the other.</p>" * 50_000 + "</article></body></html>"
    rows = spark.createDataFrame([(1, None, page, "a", 1), (None, "u", None, "b", 2)], "page_id long, url string, html string, text string, _id long")
    found = {r["page_id"]: r for r in html.main_texts(rows).collect()}
    assert found[1]["text"].count("\n") == 49_999 and found[1]["url"] is None
    assert (found[None]["text"], found[None]["n_chars"], found[None]["url"]) == ("", 0, "u")
