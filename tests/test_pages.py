import random
from html.parser import HTMLParser

from fieldpulse.operators import pages as P

PAGE = """
<table><tr class="TableBase-headTr"><th>x</th></tr>
<tr class="TableBase-bodyTr"><td>Team</td><td>Player</td><td>Pos</td><td>Injury</td></tr>
<tr class='row TableBase-bodyTr '>
 <td><span><img class="TeamLogo-image" data-lazy="a.png" src="b.png"></span><a href="/t">Hawks</a></td>
 <td><span class="CellPlayerName--short"><a>J. Doe</a></span><span class="CellPlayerName--long"><a href="/p">Jo
 Doe</a></span></td><td>WR</td><td>Knee &amp; Ankle</td></tr>
<TR CLASS="TableBase-bodyTr"><td><img src="c.png" class="big TeamLogo-image">Bears</td>
 <td><span class="CellPlayerName--long">Al &lt;Roe&gt;</span></td><td>CB</td><td>Illness</td></TR>
<tr class="TableBase-bodyTr"><td>Colts</td><td><span class="CellPlayerName--long">Di Poe</span></td><td>K</td><td></td></tr>
<tr class="TableBase-bodyTr"><td><img class="TeamLogo-image" alt="none">Jets</td>
 <td><span class="CellPlayerName--long">Ed Foe</span></td><td>P</td><td>Hand</td></tr>
<tr class="TableBase-bodyTrExtra"><td>not a row</td></tr></table>
"""


def test_injury_report(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>no rows</p>"), (3, None)], "page_id int, html string")
    found = [tuple(r)[2:] for r in P.injury_report(df).orderBy("row_number").collect()]
    assert found == [
        ("a.png", "Hawks", "Jo\n Doe", "WR", "Knee & Ankle"),
        ("c.png", "Bears", "Al <Roe>", "CB", "Illness"),
        ("", "Colts", "Di Poe", "K", ""),
        ("", "Jets", "Ed Foe", "P", "Hand"),
    ]


def test_link_rows(spark):
    html = '<ul><li>first</li><li><a class="x" href="/a">A&amp;B</a></li><li>none</li></ul>'
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [tuple(r) for r in P.link_rows(df).collect()] == [
        (1, 0, "", "first"), (1, 1, "/a", "A&B"), (1, 2, "", "none")
    ]


def test_whole_pages_are_read(spark):
    html = "<ul><li>0</li>" + "<p>" + "x" * 300_000 + "</p>" + "<li><a href='/end'>end</a></li></ul>"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [r["href"] for r in P.link_rows(df).collect()] == ["", "/end"]


class _Lists(HTMLParser):
    """Text and depth of every list item, by a real parser."""

    def __init__(self):
        super().__init__()
        self.rows, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "li":
            self.open.append(len(self.rows))
            self.rows.append([len(self.open) - 1, ""])

    def handle_endtag(self, tag):
        if tag == "li" and self.open:
            self.open.pop()

    def handle_data(self, data):
        for at in self.open:
            self.rows[at][1] += data


def test_nested_lists_equal_a_parser(spark):
    rng = random.Random(2)

    def made(depth):
        items = []
        for _ in range(rng.randrange(1, 4)):
            inner = f"<ul class='x'>{made(depth + 1)}</ul>" if depth < 4 and rng.random() < 0.5 else ""
            name = rng.choice(["a", "b &amp; c", "&lt;li&gt;", "&#228;&#xE9;&#128512;", "&copy; &zzz; &", "liked <link> x"])
            items.append(f"<LI id=1>{name}{inner}tail</li >")
        return "\n".join(items)

    texts = [f"<ul>{made(0)}</ul>" for _ in range(30)] + ["<li>open <ul><li>in</li>", "none", "", None]
    texts += ["<style>li{}</style><script>'<li>'</script><!-- <li> --><li>one</li>"] * 3
    df = spark.createDataFrame([(min(i, 34), t) for i, t in enumerate(texts)], "page_id int, html string").repartition(5)
    got = sorted((r.page_id, r.row_number, r.depth, r.label) for r in P.nested_links(df).collect())
    want = []
    for i, text in enumerate(texts):
        parser = _Lists()
        parser.feed(text or "")
        parser.close()
        want += [(min(i, 34), n, depth, label) for n, (depth, label) in enumerate(parser.rows)]
    assert got == sorted(want)


def test_references_are_resolved_once(spark):
    texts = ["&amp;lt;", "&#0;&#xD800;&#x110000;", "&nbsp;&eacute;&hellip;", "a & b; &;", None, "&amp;&amp;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(P.resolved("t")).collect()]
    assert got == ["&lt;", "\x00&#xD800;&#x110000;", " é…", "a & b; &;", None, "&&"]


def test_a_page_is_cut_after_it_is_placed_and_a_reference_read_once(spark):
    df = spark.createDataFrame([(1, "<ul><li>a &amp; b</li></ul>")] * 2, "page_id int, html string")
    rows = P.element_rows(df, "li")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # Cut before, its pieces are moved and sorted to be merged; whole pages are only hashed.
    assert "SortAggregate" not in plan
    assert len(rows.collect()) == 2
    read = df.select(P.resolved("html"))._jdf.queryExecution().optimizedPlan().toString()
    assert read.count("regexp_extract(") <= 2
    tags = spark.createDataFrame([("<a href=''>",), ("<a>",), ("<a href='x' href='y'>",)], "t string")
    assert [r[0] for r in tags.select(P.attribute("t", "href")).collect()] == ["", None, "x"]
