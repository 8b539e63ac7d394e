"""Tables out of stored web pages.

Works on a column of page texts that are already there; nothing is fetched. All
parsing is done by Spark's own text functions over the whole page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.functions import vocabulary
from fieldpulse.functions.columns import as_column

_TAG = r"(?s)<[^>]*>"


def inner_html(html: Column | str, tag: str, css_class: str | None = None) -> Column:
    """Contents of all elements of a tag, optionally of one class, in page order."""
    wanted = rf"\b(?=[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?{css_class}(?:\s[^\"']*)?[\"'])" if css_class else r"\b"
    pattern = rf"(?is)<{tag}{wanted}[^>]*>(.*?)</{tag}\s*>"
    return F.regexp_extract_all(as_column(html), F.lit(pattern), F.lit(1))


def first_inner_html(html: Column | str, tag: str, css_class: str | None = None) -> Column:
    return F.get(inner_html(html, tag, css_class), F.lit(0))


def open_tag(html: Column | str, tag: str, css_class: str | None = None) -> Column:
    """The first opening tag with its attributes, or null."""
    wanted = rf"(?=[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?{css_class}(?:\s[^\"']*)?[\"'])" if css_class else ""
    found = F.regexp_extract(as_column(html), rf"(?is)<{tag}\b{wanted}[^>]*>", 0)
    return F.nullif(found, F.lit(""))


def attribute(tag_text: Column | str, name: str) -> Column:
    """Value of an attribute of an opening tag, or null when it has none."""
    pattern = rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']"
    return F.get(F.regexp_extract_all(as_column(tag_text), F.lit(pattern), F.lit(1)), F.lit(0))


def resolved(text: Column | str) -> Column:
    """Text with its character references resolved, each once; unknown ones stay as they are.

    Named references of the table in ``vocabulary``, and decimal and hexadecimal numbers.
    """
    names = F.create_map(*[F.lit(x) for pair in vocabulary.REFERENCES.items() for x in pair])

    def code(name: Column) -> Column:
        number = F.coalesce(
            F.when(name.rlike("^#[0-9]{1,7}$"), F.conv(F.substring(name, 2, 7), 10, 16)),
            F.when(name.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.translate(F.substring(name, 3, 6), "abcdef", "ABCDEF")),
        )
        return F.when(name.startswith("#"), F.lpad(number, 8, "0"))

    def one(p: Column) -> Column:
        valid = ~p["code"].between("0000D800", "0000DFFF") & (p["code"] <= "0010FFFF")
        character = F.coalesce(
            F.try_element_at(names, p["name"]), F.when(valid, F.decode(F.unhex(p["code"]), "UTF-32"))
        )
        rest = F.substring(p["piece"], F.length(p["name"]) + 3, F.length(p["piece"]))
        return F.coalesce(F.concat(character, rest), p["piece"])

    pieces = F.split(as_column(text), "(?=&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)", -1)
    # In steps, since what a step makes of a piece is read several times by the next.
    named = F.transform(
        pieces, lambda p: F.struct(p.alias("piece"), F.regexp_extract(p, "^&([^;]+);", 1).alias("name"))
    )
    coded = F.transform(named, lambda p: F.struct(
        p["piece"].alias("piece"), p["name"].alias("name"), code(p["name"]).alias("code")
    ))
    return F.array_join(F.transform(coded, one), "")


def plain_text(html: Column | str) -> Column:
    """Text without tags, with its character references resolved."""
    return resolved(F.regexp_replace(as_column(html), _TAG, ""))


# What holds no elements of its own: comments, scripts and styles.
_OPAQUE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def element_rows(pages: DataFrame, tag: str, html: str = "html") -> DataFrame:
    """One row per element of a tag, nested ones included: row_number, depth, row_html.

    A page is cut at the tags of that name. The running sum of opening and closing tags is
    the depth, and an element ends with the next closing tag of its depth, or with the page.
    Elements are numbered from 0 as they open; depth is 0 for outer ones. Pages that are
    repeated in full are read once and returned as often as they occur.
    """
    kept = [c for c in pages.columns if c != html]
    page = ["_key", "_hash"]
    here = rf"</?{tag}(?=[\s/>])"
    pieces = F.split(F.regexp_replace("_html", _OPAQUE, ""), rf"(?i)(?={here})", -1)
    # Placed once by page, and cut there; what follows groups and sorts inside that placement.
    whole_pages = pages.select(
        F.struct(*kept).alias("_key"), F.xxhash64(html).alias("_hash"), F.col(html).alias("_html")
    )
    once = whole_pages.repartition(*page).groupBy(*page, "_html").agg(F.count(F.lit(1)).alias("_copies"))
    single = once.select(*page, "_copies", F.posexplode(pieces).alias("_at", "_piece"))
    closes = F.col("_piece").rlike(rf"(?i)^</{tag}(?=[\s/>])")
    opens = F.col("_piece").rlike(rf"(?i)^<{tag}(?=[\s/>])")
    in_order = Window.partitionBy(*page).orderBy("_at")
    stepped = single.withColumn("_step", F.when(opens, 1).when(closes, -1).otherwise(0)).withColumn(
        "_depth", F.sum("_step").over(in_order) + (F.col("_step") == -1).cast("int")
    )
    # Opening and closing tags of one depth take turns, so the next one is the end.
    of_depth = Window.partitionBy(*page, "_depth", F.col("_step") == 0).orderBy("_at")
    ended = stepped.withColumn("_end", F.lead("_at").over(of_depth))
    whole = ended.groupBy(*page).agg(
        F.sort_array(F.collect_list(F.struct("_at", "_piece", "_step", "_depth", "_end"))).alias("_all"),
        F.max("_copies").alias("_copies"),
        F.min(F.when(F.col("_step") == 1, F.col("_depth"))).alias("_outer"),
    )

    def element(o: Column) -> Column:
        length = F.coalesce(o["_end"], F.size("_all")) - o["_at"]
        inside = F.array_join(F.transform(F.slice("_all", o["_at"] + 1, length), lambda p: p["_piece"]), "")
        return F.struct(
            (o["_depth"] - F.col("_outer")).cast("int").alias("depth"),
            F.regexp_replace(inside, "(?s)^<[^>]*>", "").alias("row_html"),
        )

    found = F.transform(F.filter("_all", lambda p: p["_step"] == 1), element)
    rows = whole.select("_key", "_copies", F.posexplode(found).alias("row_number", "_element"))
    repeated = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return repeated.select(
        *[F.col("_key")[c].alias(c) for c in kept], "row_number", "_element.depth", "_element.row_html"
    )


def page_rows(
    pages: DataFrame,
    tag: str = "tr",
    css_class: str | None = None,
    html: str = "html",
    skip: int = 1,
) -> DataFrame:
    """One row per element, numbered from 0 in page order, without the first ``skip``."""
    kept = [c for c in pages.columns if c != html]
    return pages.select(
        *kept, F.posexplode(inner_html(html, tag, css_class)).alias("row_number", "row_html")
    ).filter(F.col("row_number") >= skip)


def injury_report(pages: DataFrame, html: str = "html") -> DataFrame:
    """Injury-report rows: logo, team, player, position, injury.

    The first row of a page is its header. A row without a logo has an empty one.
    """
    rows = page_rows(pages, "tr", "TableBase-bodyTr", html)
    logo = open_tag("row_html", "img", "TeamLogo-image")
    cells = inner_html("row_html", "td")
    kept = [c for c in rows.columns if c != "row_html"]

    def cell(i: int) -> Column:
        return plain_text(F.get(cells, F.lit(i)))

    return rows.select(
        *kept,
        F.coalesce(attribute(logo, "data-lazy"), attribute(logo, "src"), F.lit("")).alias("logo"),
        cell(0).alias("team"),
        plain_text(first_inner_html("row_html", "span", "CellPlayerName--long")).alias("player"),
        cell(2).alias("position"),
        cell(3).alias("injury"),
    )


def nested_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every list item, also inside others, with its depth, the target and the text of its link."""
    rows = element_rows(pages, "li", html)
    kept = [c for c in rows.columns if c != "row_html"]
    return rows.select(
        *kept,
        F.coalesce(attribute(open_tag("row_html", "a"), "href"), F.lit("")).alias("href"),
        plain_text("row_html").alias("label"),
    )


def link_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every list item of the pages with the target and the text of its link."""
    rows = page_rows(pages, "li", None, html, skip=0)
    kept = [c for c in rows.columns if c != "row_html"]
    return rows.select(
        *kept,
        F.coalesce(attribute(open_tag("row_html", "a"), "href"), F.lit("")).alias("href"),
        plain_text("row_html").alias("label"),
    )
