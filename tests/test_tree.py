"""Pages as trees of tags, against a tree that is built tag by tag."""

import random
import re
from html import unescape
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tessera.operators import harvest
from tessera.plans import more_queries, queries

VOID = {"img", "br"}


class Tree(HTMLParser):
    """Nodes as [tag, attributes, begin, end, end of inside, children, parent]."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.lines = [0]
        for line in html.splitlines(keepends=True):
            self.lines.append(self.lines[-1] + len(line))
        self.root = ["", {}, 0, len(html), len(html), [], None]
        self.at, self.all = self.root, []
        self.feed(html)
        self.close()

    def place(self):
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), self.place(), None, None, [], self.at]
        self.at[5].append(node)
        self.all.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        if self.at[0] == tag:
            self.at[4], self.at[3] = self.place(), self.place() + len(tag) + 3
            self.at = self.at[6]


def text_of(html):
    return re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", "", html))).replace("\xa0", " ")).strip()


def brute(html):
    """{number: the block's HTML}: each first numbered header and its siblings up to the next one among them."""
    html = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", "", html)
    tree = Tree(html)
    area = next((n for n in tree.all if n[0] == "div" and "entry-content" in n[1].get("class", "").split()), None)
    out, heads = {}, []
    for n in tree.all:
        up = n
        while up is not None and up is not area:
            up = up[6]
        if area is not None and up is area and n[0] == "h5" and (m := re.search(harvest.NUMBER, text_of(html[n[2] : n[3]]))) and int(m[1]) not in out:
            out[int(m[1])] = n
            heads.append(n)
    for number, n in out.items():
        stop = next((s for s in n[6][5][n[6][5].index(n) + 1 :] if any(s is h for h in heads)), None)
        out[number] = html[n[2] : stop[2] if stop else n[6][4]]
    return out


def page(rng):
    number = lambda: f"\\(\\textbf{{{rng.randint(1, 9)})}}\\)"

    def inside(depth, heads=True):
        parts = []
        for _ in range(rng.randint(0, 4)):
            k = rng.random()
            if k < 0.3 and depth:
                tag = rng.choice(["div", "section", "article", "ul", "table"])
                parts.append(f"<{tag} class=\"{rng.choice(['x', 'box y', 'sh-content', 'sh-link', 'content'])}\">{inside(depth - 1, heads)}</{tag}>")
            elif k < 0.55 and heads:
                parts.append(f"<h5>{number() if rng.random() < 0.8 else 'plain'} {rng.choice(['', 'Why?', inside(1, False)])}<div class='q'><div>{rng.choice('abc')}</div></div></h5>")
            else:
                parts.append(rng.choice(["text &amp; more &#8217;&#x27; &nope; &frac12;", "<p>p</p>", '<img src="https://x/1.png">', "<b>b</b><br>", "<!-- </div><h5> -->", "a < b", "\n", "<script>'</div>'</script>"]))
        return "".join(parts)

    before, after = inside(2), inside(2)
    return f'<html><body>{before}<div class="post entry-content">{inside(3)}{inside(3)}{inside(3)}</div>{after}</body></html>'


def test_blocks_of_random_pages(spark):
    rng = random.Random(4)
    pages = [page(rng) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    got = {}
    for r in harvest.blocks(df).collect():
        got.setdefault(r.page_id, {})[r.number] = r.html
    want = {i: b for i, p in enumerate(pages) if (b := brute(p))}
    assert got == want and len(want) > 100


def test_texts(spark):
    rng = random.Random(5)
    texts = [page(rng) for _ in range(40)] + ["&#0; &#xD800; &#x1F642; &#128512; &#99999999; &copy &copy;", "", "x<!-- open", "<style>a", "&amp;lt;"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", harvest.strip_tags(F.col("t")).alias("s")).collect()
    known = {r.i: r.s for r in got}
    for i, t in enumerate(texts[:40]):
        assert known[i] == text_of(t), t
    assert [known[i] for i in range(40, 45)] == ["\ufffd \ufffd 🙂 😀 \ufffd &copy ©", "", "x", "", "&lt;"]


@pytest.mark.parametrize(("html", "inside"), [
    ('<p>x</p><div class="a sh-content b">1<div>2</div>3</div>4', "1<div>2</div>3"), ('<DIV class="sh-content">1<Div/>2</DIV>3', "1<Div/>2"), ('<div class="sh-content">1<div>2', "1<div>2"),
    ('<div class="sh-contents">1</div>', None), ("", None), ('<div class="sh-content"></div>', ""), ('<div class="sh-content">1</section></div>2', "1</section>"),
])
def test_elements_end_at_their_own_tag(spark, html, inside):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(harvest.element(F.col("h"), harvest.ANSWER, "div").alias("e")).first().e == inside


def test_elements_taken_out(spark):
    html = 'a<div class="sh-link">x<div>y</div></div>b<div>c<div class="sh-link"><div class="sh-link">z</div></div>d</div>'
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(harvest.without(F.col("h"), harvest.LINK, "div").alias("e")).first().e == "ab<div>cd</div>"


def test_a_blocks_tree(spark):
    found = spark.createDataFrame([(1, 2, '<h5 class="q">one<div>two <b>three</b></div>four</h5><section>five</section>')], "page_id int, number int, html string")
    got = [(r.depth, r.tag, r.classes, r.text) for r in harvest.tree(found).orderBy("place").collect()]
    assert got == [(1, "h5", "q", "one"), (2, "div", "", "two three"), (1, "div", "", "four"), (1, "section", "", "five")]


def test_null_and_empty_pages(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "<div class='entry-content'></div>"), (3, '<div class="entry-content"><h5>\\textbf{1)}</h5>')], "page_id int, html string")
    assert [(r.page_id, r.number, r.html) for r in harvest.blocks(df).collect()] == [(3, 1, "<h5>\\textbf{1)}</h5>")]
    assert harvest.blocks(df.where("false"), fallback=True).count() == 0


def test_numbers_of_more_than_three_digits(spark):
    head = lambda n: f"<h5>\\(\\textbf{{{n})}}\\) Question</h5>x"
    df = spark.createDataFrame([(1, f'<div class="entry-content">{head(999)}{head(1000)}{head(12345)}{head(99999999999)}</div>')], "page_id int, html string")
    found = harvest.blocks(df, numbered=harvest.ANY_NUMBER).orderBy("number")
    assert [(r.number, r.html) for r in found.collect()] == [(999, head(999)), (1000, head(1000)), (12345, head(12345) + head(99999999999))]
    assert [r.stem for r in harvest.fields(found, harvest.ANY_NUMBER).collect()] == ["Question"] * 3
    assert [r.number for r in harvest.blocks(df).collect()] == [999]  # the source's own layout


def test_characters_beyond_the_basic_plane(spark):
    df = spark.createDataFrame([('\U0001f600\U0001d6d1<div class="sh-content">1<div>\U0001f642</div>3</div>4',)], "h string")
    assert df.select(harvest.element(F.col("h"), harvest.ANSWER, "div").alias("e")).first().e == "1<div>\U0001f642</div>3"


@pytest.mark.parametrize("name", ["harvest_survey", "harvest_block_fields", "harvest_unusable", "harvest_records"])
def test_long_pages_equal_the_sql(spark, tmp_path, name):
    """Over 999 paragraphs, characters of two code units, pages without an id, a text or a paragraph."""
    import duckdb

    page = lambda text, n: "<html><body>" + "".join(f"<p>{text} {i}</p>" for i in range(n)) + "</body></html>"
    rows = [(0, page("word", 1205)), (1, page("\U0001f600" * 150, 12)), (2, page("w", 999)), (3, page("w", 1000)), (4, page("w", 1001)), (None, page("w", 3)), (9, page("w", 3)), (-1, page("w", 3)), (5, None), (6, ""), (7, page("w", 0))]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = getattr(more_queries, name)(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
