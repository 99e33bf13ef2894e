"""HTML to Markdown: golden pairs, rules, signals, regions, custom fields."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lucidex.operators import conversion
from lucidex.operators.html_tree import main_region

#: name -> (HTML, Markdown)
GOLDEN = {
    "headings": ("<h1>Top</h1>\n<h2>Part</h2>\n<h6>Deep</h6><h3> </h3>", "# Top\n\n## Part\n\n###### Deep\n"),
    "inline": ("<p>First <em>soft</em> and <strong>loud</strong>.</p>\n<p>With <code>x()</code> and a hard<br>break.</p>",
               "First *soft* and **loud**.\n\nWith `x()` and a hard  \nbreak.\n"),
    "lists": ("<ul>\n<li>A</li>\n<li>B</li>\n</ul>\n<ol>\n<li>One</li>\n<li>Two</li>\n</ol>",
              "- A\n- B\n\n1. One\n2. Two\n"),
    "nested list": ("<ul>\n<li>Top\n<ul>\n<li>In A</li>\n<li>In B</li>\n</ul>\n</li>\n<li>Next</li>\n</ul>",
                    "- Top\n  - In A\n  - In B\n- Next\n"),
    "links and images": ('<p>A <a href="https://e.com">link</a>.</p><p>Pic: <img src="/c.jpg" alt="Cat"></p>',
                         "A [link](https://e.com).\n\nPic: ![Cat](/c.jpg)\n"),
    "code block": ('<p>Below:</p><pre><code class="x language-php">f(1);\n  g();\n</code></pre>',
                   "Below:\n\n```php\nf(1);\n  g();\n```\n"),
    "quote": ("<blockquote>\n<p>One.</p>\n<p>— Who</p>\n</blockquote>", "> One.\n>\n> — Who\n"),
    "table": ("<table><thead><tr><th>M</th><th>R</th></tr></thead><tbody><tr><td>a()</td><td>v</td></tr>"
              "<tr><td>b</td></tr></tbody></table>", "| M | R |\n| --- | --- |\n| a() | v |\n| b |  |\n"),
    "block comments": ("<!-- wp:heading -->\n<h2>Head</h2>\n<!-- /wp:heading -->\n\n<!-- wp:paragraph -->\n<p>Text.</p>\n"
                       "<!-- /wp:paragraph -->", "## Head\n\nText.\n"),
    "figure": ('<figure>\n<img src="/d.png" alt="D">\n<figcaption>Fig 1</figcaption>\n</figure>', "![D](/d.png)\n*Fig 1*\n"),
    "linked figure": ('<figure><a href="/big"><img src="/d.png" alt="D"></a></figure>', "[!\\[D\\](/d.png)](/big)\n"),
    "embed": ('<figure class="wp-block-embed is-video"><div><iframe src="https://v.com/1"></iframe></div></figure>',
              "[https://v.com/1](https://v.com/1)\n"),
    "link edge cases": ('<p><a href="https://e.com/a)b">paren</a> <a href="/x">a ] b</a> <img src="/a)b.jpg" alt="A ] b">'
                        ' <a href="/y"> </a> <a>plain</a></p>',
                        "[paren](https://e.com/a\\)b) [a \\] b](/x) ![A \\] b](/a\\)b.jpg) [/y](/y) plain\n"),
    "backticks": ("<p><code>use `a`</code> <code>`p</code> <code>s`</code> <code></code></p>",
                  "`` use `a` `` `` `p `` `` s` `` ``\n"),
    "unclosed": ("<p><b>One<br><p>Two &amp; three<ul><li>a<li>b</ul>", "**One  \n**\n\nTwo & three\n\n- a\n- b\n"),
    "rule and span": ("<div><span>a</span><hr><section>b</section></div>", "a\n\n---\n\nb\n"),
    "misnested": ("<p>open<strong>and<em>nested</strong>only", "open**and*nested***only\n"),
    "caption": ('[caption id="1"]<img src="x.jpg" alt="" /> Words here[/caption]', "![](x.jpg) Words here\n"),
    "script, style, noscript": ("<style>.a{}</style><p>Kept.</p><script>var t='</p>';</script><noscript>no</noscript>",
                                "Kept.\n"),
    "blob": ("<p>In. " + "QWxhZGRpbg" * 7 + " Out.</p><p>Order ABC123XYZ.</p>", "In. Out.\n\nOrder ABC123XYZ.\n"),
    "data uri": ('<p><img src="data:image/png;base64,' + "iVBORw0KGg" * 8 + '" alt="l"></p>',
                 "![l](data:image/png;base64," + "iVBORw0KGg" * 8 + ")\n"),
    "no-break space": ("<p>a  b</p><p> </p>", "a b\n"),
}


@pytest.fixture(scope="module")
def converted(spark):
    extra = {"empty": "", "oversize": "a" * (conversion.MAX_INPUT_BYTES + 1),
             "images": '<p><img src="x.jpg"></p><p>Text</p>', "deep": "<div>" * 6 + "Body" + "</div>" * 6,
             "clean": "<h1>T</h1><p>One.</p><p>Two.</p>",
             "soup": '<div class="a">' * 6 + '<div class="r" style="m"><p style="c" class="x">P</p></div>' * 20 + "</div>" * 6,
             "broken table": "<table><tr><td>a</td></tr></table><table></table>",
             "very deep": "<div>" * 70 + "lost" + "</div>" * 70}
    rows = [(name, html) for name, (html, _) in GOLDEN.items()] + list(extra.items())
    frame = spark.createDataFrame(rows, "name string, body_html string")
    return {r["name"]: r for r in conversion.convert(frame, ["name"]).collect()}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(converted, name):
    assert converted[name]["markdown"] == GOLDEN[name][1]


def test_empty_and_oversize_score_100(converted):
    for name in ("empty", "oversize"):
        row = converted[name]
        assert (row["markdown"], row["quality_score"], row["signals"]["tag_total_count"]) == ("", 100, 0)


def test_signals(converted):
    assert converted["images"]["signals"]["image_only_paragraph_count"] == 1
    assert converted["images"]["signals"]["paragraph_total_count"] == 2
    assert converted["deep"]["signals"]["deep_div_count"] == 2
    assert converted["broken table"]["signals"]["table_fragment_count"] == 2
    assert converted["clean"]["quality_score"] >= 85
    assert converted["soup"]["quality_score"] < 80
    assert all(0 <= r["quality_score"] <= 100 for r in converted.values())
    assert len(converted["clean"]["signals"].asDict()) == 18
    assert converted["very deep"]["markdown"] == "\n"


def test_score_formula(spark):
    counters = {"empty_tags": 1, "tags": 4, "styled_tags": 5, "broken_tables": 1, "tables": 2, "deep_divs": 1, "divs": 4,
                "image_paragraphs": 1, "paragraphs": 2}
    row = spark.range(1).select(F.lit("ab [x y] \n\n \n c").alias("markdown"),
                                *[F.lit(v).alias(k) for k, v in counters.items()])
    scored = conversion.score_rows(row).first()
    want = 100 - 25 / 4 - 20 * 0.5 - 15 / 2 - 10 / 4 - 10 / 2 - 10 * 0.1 - 10 * 0.2
    assert scored["quality_score"] == int(want + 0.5)


def test_order_and_partitioning_do_not_matter(spark):
    rows = spark.createDataFrame([(i, GOLDEN[n][0]) for i, n in enumerate(GOLDEN)], "i int, body_html string")
    first = {tuple(r) for r in conversion.convert(rows, ["i"]).select("i", "markdown", "quality_score").collect()}
    again = {tuple(r) for r in conversion.convert(rows.orderBy(F.rand(3)).repartition(7), ["i"])
             .select("i", "markdown", "quality_score").collect()}
    assert first == again


REGIONS = [
    ('<body><nav>Menu</nav><main><p>Main body.</p></main><footer>Foot</footer></body>', "Main body.", "Menu"),
    ("<body><article><p>Article only.</p></article></body>", "Article only.", "zzz"),
    ('<body><div role="main"><p>By role.</p></div><p>Other</p></body>', "By role.", "Other"),
    ('<body><div class="side"><p>Widgets</p></div><div class="x entry-content"><p>Hinted.</p></div></body>', "Hinted.", "Widgets"),
    ('<main><nav><a href="/x">Skip</a></nav><p>Kept.</p></main>', "Kept.", "Skip"),
    ('<main><div role="navigation">Menu</div><p>Kept.</p></main>', "Kept.", "Menu"),
    ("<main><script>bad()</script><style>.x{}</style><p>Kept.</p></main>", "Kept.", "bad"),
    ('<div class="l"><a href="/1">one</a></div><div class="b"><p>' + "Real prose here. " * 20 + "</p></div>", "Real prose", "one"),
    ("<body><p>Short note.</p></body>", "Short note.", "zzz"),
]


@pytest.mark.parametrize("html, kept, gone", REGIONS)
def test_main_region(html, kept, gone):
    out = main_region(html)
    assert kept in out and gone not in out


def test_main_region_of_blank_and_broken():
    assert main_region("   ") == ""
    assert "open" in main_region("<main><p>open<div>x</main>")
    assert main_region('<main><a href="/?a=1&amp;b=2">A &lt; B</a><br></main>') == '<a href="/?a=1&amp;b=2">A &lt; B</a><br>'


def test_main_region_job(spark):
    rows = spark.createDataFrame([(1, REGIONS[0][0])], "i int, body_html string")
    assert conversion.main_regions(rows, ["i"]).first()["region_html"] == "<p>Main body.</p>"


FIELDS = [
    ({"a": {"type": "text", "value": " Hi <b>. "}, "b": {"type": "textarea", "value": "One\nTwo"},
      "c": {"type": "wysiwyg", "value": "<p>Rich</p>"}}, "<p>Hi &lt;b&gt;.</p>\n<p>One<br />\nTwo</p>\n<p>Rich</p>"),
    ({"i": {"type": "image", "value": 12}, "n": {"type": "number", "value": 7}, "t": {"type": "text", "value": "Real"}},
     "<p>Real</p>"),
    ({"x": {"type": "text", "value": "  "}, "y": {"type": "text", "value": None}}, None),
    ({"g": {"type": "group", "sub_fields": [{"name": "t", "type": "text"}, {"name": "i", "type": "image"}],
            "value": {"t": "In group", "i": 5}}}, "<p>In group</p>"),
    ({"c": {"type": "clone", "sub_fields": [{"name": "t", "type": "text"}], "value": {"t": "Cloned"}}}, "<p>Cloned</p>"),
    ({"r": {"type": "repeater", "sub_fields": [{"name": "q", "type": "text"}],
            "value": [{"q": "First?"}, {"q": "Second?"}]}}, "<p>First?</p>\n<p>Second?</p>"),
    ({"f": {"type": "flexible_content", "layouts": [{"name": "hero", "sub_fields": [{"name": "h", "type": "text"}]}],
            "value": [{"acf_fc_layout": "hero", "h": "Hero"}, {"acf_fc_layout": "gone", "h": "No"}]}}, "<p>Hero</p>"),
    ({"g": {"type": "group", "sub_fields": [{"name": "r", "type": "repeater", "sub_fields": [{"name": "e", "type": "email"}]}],
            "value": {"r": [{"e": "a@b.c"}]}}}, "<p>a@b.c</p>"),
]


def test_custom_fields(spark):
    rows = spark.createDataFrame([(i, json.dumps(f)) for i, (f, _) in enumerate(FIELDS)] + [(99, "not json"), (98, None)],
                                 "i int, fields_json string")
    html = conversion.field_html(conversion.field_rows(rows, ["i"]), ["i"])
    got = {r["i"]: r["field_html"] for r in html.collect()}
    assert got == {i: want for i, (_, want) in enumerate(FIELDS) if want is not None}


def test_source_choice(spark):
    cases = [("<p>B</p>", "<p>F</p>", "<p>R</p>", "post", "S", "<p>B</p>"),
             ("<p> </p>", "<p>F</p>", "<p>R</p>", "post", "", "<p>F</p>\n<p> </p>"),
             ("", "", " <p>R</p> ", "post", "", "<p>R</p>"), ("", "", "", "post", "", ""),
             ("<p>B</p>", "", "", "product", "S", "S\n<p>B</p>"), ("", "<p>F</p>", "", "product", "S", "S\n")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                                 "i int, b string, f string, r string, t string, s string, want string")
    chosen = conversion.source_html(*[F.col(c) for c in "bfrts"])
    for row in rows.select("want", chosen.alias("got")).collect():
        assert row["got"] == row["want"]
