"""Problems from pages: numbered blocks, their stems, answers and images, and what a page's layout holds.

All in built-in expressions over pages(page_id, html), a page in a row and no shuffle. A page is cut at the tags that make its
tree; a running sum of +1 for an opening and -1 for a closing tag is the depth, so an element ends at its own closing tag,
and a numbered header's siblings end with their parent or at the next numbered header among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import records


def _open(tag: str, name: str | None = None) -> str:
    """Pattern of an element's opening tag, of a class where one is given."""
    return rf"<{tag}\b[^>]*\bclass=\"[^\"]*\b{name}\b[^\"]*\"[^>]*>" if name else rf"<{tag}(?:\s[^>]*)?>"


#: Elements that hold others and whose end tag can't be left out; only they count towards the depth.
CONTAINERS = "article|aside|blockquote|body|button|details|div|figure|footer|form|h[1-6]|header|main|nav|ol|section|table|ul"
#: Fixed patterns of the source's layout.
NUMBER = r"\\textbf\{\s*(\d{1,3})\s*\)\s*\}"
#: The same for pages with more problems than three digits number.
ANY_NUMBER = NUMBER.replace("{1,3}", "+")
ANSWER, LINK, HEAD = _open("div", "sh-content"), _open("div", "sh-link"), _open("h5")
BUTTON = r"(?is)<button\b.*?</button\s*>"
IMAGE = r"<img[^>]*\bsrc=\"([^\"]*)\""
PLAY_BUTTON = "play"
#: Where a page's problems may be, in the order in which they are tried; the body is the last resort.
AREAS = {"entry-content": ("div", "entry-content"), "article": ("article", None), "main": ("main", None), "post-content": ("div", "post-content"), "content": ("div", "content"), "body": ("body", None)}
#: Traces of the ways in which pages show formulas.
MARKERS = ("\\(", "\\[", "$$", "latex", "MathJax", "katex")
#: Named characters that texts of pages use.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "deg": "°", "plusmn": "±", "sup2": "²", "sup3": "³", "middot": "·", "frac12": "½", "frac14": "¼", "frac34": "¾",
    "times": "×", "divide": "÷", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "bull": "•", "pi": "π", "theta": "θ", "alpha": "α", "beta": "β", "minus": "−",
    "radic": "√", "infin": "∞", "asymp": "≈", "ne": "≠", "le": "≤", "ge": "≥", "ang": "∠", "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "prime": "′", "thinsp": " ", "ensp": " ", "emsp": " ",
}


# --- the tree -------------------------------------------------------------------------------------
def markup(html: Column) -> Column:
    """A page without comments, scripts and styles, whose contents aren't elements; what is not closed goes to the end."""
    return F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)", "")


def _pieces(html: Column, names: str) -> Column:
    """The text cut before each tag of these names: a piece is a tag and what follows it."""
    return F.split(html, rf"(?i)(?=</?(?:{names})(?:\s[^>]*)?>)", -1)


def _step(piece: Column, names: str) -> Column:
    """What a piece's tag does to the depth."""
    return F.when(piece.rlike(rf"(?i)^<(?:{names})(?:\s[^>]*)?>"), F.when(piece.rlike(r"^<[^>]*/>"), 0).otherwise(1)).when(piece.rlike(rf"(?i)^</(?:{names})\s*>"), -1).otherwise(0)


def element(html: Column, opening: str, name: str) -> Column:
    """What is in the first element whose opening tag matches, up to its own closing tag; null if there is none. One that isn't closed goes to the end."""
    # not cut at a place: regexp_instr counts a character beyond U+FFFF twice, substr once
    pieces = _pieces(F.regexp_extract(html, f"(?is)({opening}.*)", 1), name)
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def take(s: Column, p: Column) -> Column:
        depth = s["depth"] + _step(p, name)
        over = s["over"] | ((depth <= 0) & (s["n"] > 0))
        return F.struct(F.when(over, 0).otherwise(depth).alias("depth"), F.when(over, s["n"]).otherwise(s["n"] + 1).alias("n"), over.alias("over"))

    inside = F.array_join(F.slice(pieces, 1, F.greatest(F.aggregate(pieces, zero, take, lambda s: s["n"]), F.lit(1))), "")
    return F.when(html.rlike(f"(?i){opening}"), F.regexp_replace(inside, r"^<[^>]*>", ""))


def without(html: Column, opening: str, name: str) -> Column:
    """The text without the elements whose opening tag matches, whatever is in them."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def take(s: Column, p: Column) -> Column:
        starts = (s["depth"] == 0) & p.rlike(f"(?i)^{opening}")
        depth = F.when(starts, 1).when(s["depth"] > 0, s["depth"] + _step(p, name)).otherwise(0)
        left = F.when(starts | (depth > 0), F.lit("")).when(s["depth"] > 0, F.regexp_replace(p, r"^<[^>]*>", "")).otherwise(p)
        return F.struct(depth.alias("depth"), F.concat(s["out"], left).alias("out"))

    return F.aggregate(_pieces(html, name), zero, take, lambda s: s["out"])


def tree(found: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, number, place, depth, tag, classes, text) of each container in a block: its dump as rows, in the order of place."""
    pieces = found.select("page_id", "number", F.posexplode(_pieces(markup(F.col(html)), CONTAINERS)).alias("place", "piece"))
    step = _step(F.col("piece"), CONTAINERS)
    upto = Window.partitionBy("page_id", "number").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # a block of one page
    tag = F.lower(F.regexp_extract("piece", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    out = pieces.select("page_id", "number", "place", F.sum(step).over(upto).alias("depth"), tag.alias("tag"), step.alias("step"), F.regexp_extract("piece", r"^<[^>]*\bclass=\"([^\"]*)\"", 1).alias("classes"), strip_tags(F.col("piece")).alias("text"))
    return out.where("step > 0 OR text <> ''").drop("step")


def unescape(text: Column) -> Column:
    """Characters for their numbers and names; what names nothing stays."""
    pieces = F.split(text, r"(?=&(?:#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});)", -1)
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(p: Column) -> Column:
        said = F.regexp_extract(p, r"^&(#?[A-Za-z0-9]+);", 1)
        number = F.when(said.rlike("^#[xX]"), F.conv(F.substr(said, F.lit(3)), 16, 10)).when(said.startswith("#"), F.substr(said, F.lit(2))).cast("long")
        known = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(known, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        found = F.when(number.isNotNull(), char).otherwise(F.try_element_at(names, said))
        return F.when((said != "") & found.isNotNull(), F.concat(found, F.regexp_replace(p, r"^&[^;]*;", ""))).otherwise(p)

    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def strip_tags(html: Column) -> Column:
    """Text of a piece of HTML: comments, scripts, styles and tags out, characters decoded, white space collapsed."""
    s = F.regexp_replace(markup(html), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(s), r"[\s\x{A0}]+", " "))


# --- pages ----------------------------------------------------------------------------------------
def content_area(pages: DataFrame) -> DataFrame:
    """The pages with area, which of AREAS they have first, and content, what is in that element; a page without any is its own content."""
    out = pages.withColumn("_markup", markup(F.col("html")))
    which = F.coalesce(*[F.when(F.col("_markup").rlike(f"(?i){_open(*how)}"), F.lit(name)) for name, how in AREAS.items()])
    out = out.withColumn("area", which)
    content = F.col("_markup")
    for name, how in AREAS.items():
        content = F.when(F.col("area") == name, element(F.col("_markup"), _open(*how), how[0])).otherwise(content)
    return out.withColumn("content", content).drop("_markup")


def blocks(pages: DataFrame, fallback: bool = False, numbered: str = NUMBER) -> DataFrame:
    """(page_id, number, html) of each numbered block, the first of each number.

    A block is a header h5, wherever it is in the content area, and its siblings up to the next such header among them or
    their parent's end. A page without the content area has none; with `fallback` other areas and the whole page
    count too. A page is one document, so its parts stay together in one row: no shuffle. Null pages have no blocks.
    `numbered` is the pattern of a header's number; a number that an int can't hold makes no header. What reads the blocks takes the same pattern.
    """
    if fallback:
        found = content_area(pages)
    else:
        found = pages.withColumn("_markup", markup(F.col("html"))).withColumn("content", element(F.col("_markup"), _open(*AREAS["entry-content"]), "div"))
    parts = found.select("page_id", F.split(F.coalesce("content", F.lit("")), r"(?i)(?=<h5(?:\s[^>]*)?>)", -1).alias("parts"))
    number = lambda p: F.when(p.rlike(f"(?i)^{HEAD}"), F.nullif(F.regexp_extract(strip_tags(element(p, f"^{HEAD}", "h5")), numbered, 1), F.lit("")).try_cast("int"))
    parts = parts.withColumn("numbers", F.transform("parts", number))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))

    def sink(s: Column, p: Column) -> Column:
        depth = s["depth"] + _step(p, CONTAINERS)
        return F.struct(depth.alias("depth"), F.least(s["low"], depth).alias("low"))

    # each part: the number that it brings if that wasn't there before, how much deeper it ends, and how far up it goes
    new = lambda i: F.when(~F.coalesce(F.array_contains(F.slice("numbers", 1, i), F.get("numbers", i)), F.lit(False)), F.get("numbers", i))
    parts = parts.withColumn("units", F.transform("parts", lambda p, i: F.struct(new(i).alias("new"), F.aggregate(_pieces(p, CONTAINERS), start, sink).alias("s"))))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("cut"), F.lit(False).alias("over"))

    def go(s: Column, u: Column) -> Column:
        over = s["over"] | s["cut"] | ((s["n"] > 0) & (s["depth"] == 0) & u["new"].isNotNull())
        cut = ~over & (s["depth"] + u["s"]["low"] < 0)  # the parent ends within this part
        return F.struct(
            F.when(over | cut, s["depth"]).otherwise(s["depth"] + u["s"]["depth"]).alias("depth"), F.when(over, s["n"]).otherwise(s["n"] + 1).alias("n"), (s["cut"] | cut).alias("cut"), over.alias("over"),
        )

    def until_up(p: Column, depth: Column) -> Column:
        """The pieces of a part before the depth falls below 0."""
        first = F.struct(depth.alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("over"))

        def take(s: Column, x: Column) -> Column:
            to = s["depth"] + _step(x, CONTAINERS)
            over = s["over"] | (to < 0)
            return F.struct(to.alias("depth"), F.when(over, s["n"]).otherwise(s["n"] + 1).alias("n"), over.alias("over"))

        pieces = _pieces(p, CONTAINERS)
        return F.array_join(F.slice(pieces, 1, F.aggregate(pieces, first, take, lambda s: s["n"])), "")

    heads = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.get("units", i)["new"].isNotNull())
    ends = F.transform(heads, lambda i: F.struct(i.alias("i"), F.aggregate(F.slice("units", i + 1, F.size("units")), zero, go).alias("s")))

    def block(e: Column) -> Column:
        whole = e["s"]["n"] - e["s"]["cut"].cast("int")
        rest = F.when(e["s"]["cut"], until_up(F.get("parts", e["i"] + whole), e["s"]["depth"])).otherwise("")
        return F.struct(F.get("units", e["i"])["new"].alias("number"), F.concat(F.array_join(F.slice("parts", e["i"] + 1, whole), ""), rest).alias("html"))

    return parts.select("page_id", F.explode(F.transform(ends, block)).alias("b")).select("page_id", "b.number", "b.html")


def answer_of(html: Column) -> Column:
    return F.nullif(strip_tags(element(html, ANSWER, "div")), F.lit(""))


def diagram_of(html: Column) -> Column:
    """The source of the first image that isn't the play button."""
    return F.get(F.filter(F.regexp_extract_all(html, F.lit(IMAGE), F.lit(1)), lambda s: ~s.contains(PLAY_BUTTON)), F.lit(0))


def fields(found: DataFrame, numbered: str = NUMBER) -> DataFrame:
    """stem, answer_raw, image_url and whether a block can be harvested: an answer, a stem of ten characters, an image."""
    head = F.coalesce(element(F.col("html"), f"^{HEAD}", "h5"), F.lit(""))
    stem = strip_tags(F.regexp_replace(without(without(head, ANSWER, "div"), LINK, "div"), BUTTON, " "))
    for out in (numbered, r"\\\(", r"\\\)", "Show Answer"):
        stem = F.regexp_replace(stem, out, " ")
    stem = F.trim(F.regexp_replace(stem, r"\s+", " "))
    image = F.get(F.filter(F.regexp_extract_all("html", F.lit(IMAGE), F.lit(1)), lambda s: s.startswith("http") & ~s.contains(PLAY_BUTTON)), F.lit(0))
    df = found.withColumns({"stem": stem, "answer_raw": answer_of(F.col("html")), "image_url": image})
    return df.withColumn("harvestable", F.col("answer_raw").isNotNull() & (F.length("stem") >= 10) & F.col("image_url").isNotNull())


def harvest(pages: DataFrame, limit: int = 10, numbered: str = NUMBER) -> DataFrame:
    """Of each page the first `limit` harvestable blocks, by number: what a harvest takes from a page is bounded by the feature itself."""
    good = fields(blocks(pages, numbered=numbered), numbered).where("harvestable")
    own = good.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("number", "stem", "answer_raw", "image_url"))).alias("own"))  # a page's blocks
    return own.select("page_id", F.explode(F.slice("own", 1, limit)).alias("b")).select("page_id", "b.*")


def harvested_records(found: DataFrame, site: str, url: Column | str, retrieved_at: str | None = None) -> DataFrame:
    """Manifest records of harvested blocks(page_id, number, stem, answer_raw, image_url): origin `harvested`, answers still to be filled in.

    Ids are the site and the number, of two digits at least; retrieved_at: one time for the run, UTC, by default now.
    """
    id_ = F.concat(F.lit(site + "_"), F.format_string("%02d", "number"))
    when = F.lit(retrieved_at) if retrieved_at else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return records.record(
        found, problem_id=id_, family=F.lit("harvested"), category=F.lit(1), stem=F.col("stem"), image_path=records.image_path(id_), origin=F.lit("harvested"), source_site=F.lit(site),
        source_url=url if isinstance(url, Column) else F.lit(url), source_problem_id=id_, retrieved_at=when, original_answer=F.col("answer_raw"),
    )


def skipped(pages: DataFrame, numbered: str = NUMBER) -> DataFrame:
    """Numbers of a page that can't be harvested."""
    return fields(blocks(pages, numbered=numbered), numbered).where("NOT harvestable").select("page_id", "number")


def numbering(df: DataFrame, key: str = "page_id", number: str = "number") -> DataFrame:
    """Per page: least and greatest number, and the gaps between. By NUMBER a block's number has three digits at most, so a page's set of them is bounded; for ANY_NUMBER there is gap_counts."""
    out = df.groupBy(key).agg(F.collect_set(F.col(number).cast("long")).alias("all"))
    return out.select(key, F.array_min("all").alias("low"), F.array_max("all").alias("high"), F.array_sort(F.array_except(F.sequence(F.array_min("all"), F.array_max("all")), "all")).alias("gaps"))


def gap_counts(df: DataFrame, key: str, number: str) -> DataFrame:
    """Per key, however many numbers it has: least and greatest number, and how many between are missing. Counted, never gathered."""
    distinct = df.select(F.col(key), F.col(number).cast("long").alias("_n")).where("_n IS NOT NULL").distinct()
    return distinct.groupBy(key).agg(F.min("_n").alias("low"), F.max("_n").alias("high"), (F.max("_n") - F.min("_n") + 1 - F.count("*")).alias("gaps"))


def layout(found: DataFrame, numbered: str = NUMBER) -> DataFrame:
    """Per block: layout (A: the diagram is in the header; B: the header is the number alone), answer (same block, video
    only, none), hidden (the answer is collapsed), image (url, lazy stub, none), links, videos, and prompt, whether the question is in the text."""
    html, head = F.col("html"), F.coalesce(element(F.col("html"), f"^{HEAD}", "h5"), F.lit(""))
    video = html.rlike(r"(?i)youtu")
    diagram = diagram_of(html)
    lazy = html.rlike(r"<img[^>]*\bdata-src=") | diagram.startswith("data:")
    answer = answer_of(html)
    prompt = F.trim(F.replace(F.trim(F.regexp_replace(strip_tags(html), numbered, "")), F.lit("Show Answer"), F.lit("")))
    prompt = F.when(answer.isNotNull(), F.trim(F.replace(prompt, answer, F.lit("")))).otherwise(prompt)
    return found.select(
        "page_id", "number", F.when(diagram_of(head).isNotNull(), "A").otherwise("B").alias("layout"), F.when(answer.isNotNull(), "same block").when(video, "video only").otherwise("none").alias("answer"),
        html.rlike(r"<div[^>]*class=\"[^\"]*\bsh-content\b[^\"]*\bsh-hide\b|<div[^>]*\bsh-content\b[^>]*\shidden\b").alias("hidden"),
        F.when(diagram.startswith("http"), "url").when(diagram.isNotNull() & lazy, "lazy stub").otherwise("none").alias("image"),
        F.regexp_count(html, F.lit(r"<a\b")).cast("long").alias("links"), F.regexp_count(html, F.lit(r"(?i)<a\b[^>]*href=\"[^\"]*youtu")).cast("long").alias("videos"), (F.length(prompt) >= 15).alias("prompt"),
    )


def layout_counts(found: DataFrame) -> DataFrame:
    """(layout, blocks): how many blocks have which layout."""
    return layout(found).groupBy("layout").agg(F.count("*").alias("blocks"))


def survey(found: DataFrame, numbered: str = NUMBER) -> DataFrame:
    """Per page: blocks, those with an answer, with a video only and with neither, with no prompt, with a diagram's URL or a stub of it, and whether one fetch gets all diagrams."""
    rows = layout(found, numbered)
    of = lambda c, v: F.count_if(F.col(c) == v)
    out = rows.groupBy("page_id").agg(
        F.count("*").alias("blocks"), of("answer", "same block").alias("with_answer"), of("answer", "video only").alias("video_only"), of("answer", "none").alias("neither"),
        F.count_if(~F.col("prompt")).alias("no_prompt"), of("image", "url").alias("with_diagram"), of("image", "lazy stub").alias("lazy_stub"),
    )
    return out.withColumn("single_fetch", F.col("with_diagram") == F.col("blocks"))


def markers(pages: DataFrame) -> DataFrame:
    """(page_id, marker, n): how often each trace of formulas occurs in a page."""
    n = lambda m: ((F.length("html") - F.length(F.replace("html", F.lit(m), F.lit("")))) / len(m)).cast("long")
    return pages.select("page_id", F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), n(m).alias("n")) for m in MARKERS])).alias("x")).select("page_id", "x.*")
