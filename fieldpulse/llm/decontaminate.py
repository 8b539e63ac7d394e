"""Benchmark passages in documents: a prefix-filtered set join.

An item is a list of windows of so many consecutive words, and a window is a set of
shingles at known places. For a document to contain a window it must contain all of its
shingles, so the shortest necessary prefix in any order is one shingle; ordered by
rarity in the documents, it is the rarest one. Only documents' shingles that some window
has are kept at all, so one narrow pass over the documents gives both the rarity and the
candidates. A candidate has a place in the document and one in the window, which bound
where the window would begin and end; what fits is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.llm.common import SHINGLE_WORDS, Sealed, count_words, settle, words_of

WINDOW_WORDS = 13
# Shingles of a benchmark that are broadcast at once, about 60 MB. Larger benchmarks are
# handled in blocks, each in a pass of its own.
BLOCK_SHINGLES = 1_000_000


def item_windows(items: DataFrame, item_id: str, text: str, window_words: int) -> DataFrame:
    """(_item, _window): each distinct window of each item as a list of words."""
    words = items.select(F.col(item_id).alias("_item"), words_of(F.col(text)).alias("_words"))
    length = F.least(F.size("_words"), F.lit(window_words))
    starts = F.sequence(F.lit(1), F.size("_words") - length + 1)
    return (
        words.filter(F.size("_words") > 0)
        .select("_item", "_words", length.alias("_length"), F.explode(starts).alias("_start"))
        .select("_item", F.slice("_words", F.col("_start"), F.col("_length")).alias("_window"))
        .distinct()
    )


def _shingle(words: Column, start: Column, length: int) -> Column:
    """Hash of so many words from a place counted from 0."""
    return F.xxhash64(F.lit(length), *[F.get(words, start + i) for i in range(length)])


def window_shingles(windows: DataFrame) -> DataFrame:
    """(_window, _place, _long, _shingle): the shingles of each distinct window.

    A window of fewer words than a shingle is one shingle of its own length.
    """
    parts = []
    for length in range(1, SHINGLE_WORDS + 1):
        words = F.size("_window")
        here = windows.filter(words >= length if length == SHINGLE_WORDS else words == length)
        placed = here.select(
            "_window", F.explode(F.sequence(F.lit(0), words - length)).alias("_place")
        )
        parts.append(
            placed.select(
                "_window", "_place", F.lit(length).alias("_long"),
                _shingle(F.col("_window"), F.col("_place"), length).alias("_shingle"),
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _occurrences(docs: DataFrame, wanted: DataFrame, length: int, window_words: int) -> DataFrame:
    """Where documents have a wanted shingle, with the words a window around it can reach.

    No filter looks at the words, nor can Spark infer one from places made by an expression: it
    would go below their projection and find the words of a text once more.
    """
    at, last = F.col("_at"), F.size("_words") - length
    places = F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("_at")
    hashed = docs.select("_id", "_row", "_words", places).select(
        "_id", "_row", "_words", "_at", _shingle(F.col("_words"), at, length).alias("_shingle")
    )
    back = F.least(at, F.lit(window_words - length))
    return hashed.join(F.broadcast(wanted), "_shingle").select(
        "_id", "_row", "_at", "_shingle", back.alias("_back"),
        F.slice("_words", at - back + 1, back + window_words).alias("_near"),
    )


def contained_windows(
    docs: DataFrame, windows: DataFrame, window_words: int, block_shingles: int
) -> DataFrame:
    """(_id, _row, _start, _end, _window): where documents contain windows, end exclusive.

    ``docs`` has ``_id``, ``_row`` and ``_words``.
    """
    shingles = settle(window_shingles(windows.select("_window").distinct()))
    sizes = shingles.groupBy("_long").agg(F.count_distinct("_shingle").alias("n")).collect()
    found = None
    for r in sizes:
        length, blocks = r["_long"], -(-r["n"] // block_shingles)
        wanted = shingles.filter(F.col("_long") == length).select("_shingle").distinct()
        for b in range(blocks):
            block = wanted.filter(F.pmod("_shingle", F.lit(blocks)) == b)
            part = _occurrences(docs, block, length, window_words)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.select(
            "_id", "_row", F.lit(0).alias("_start"), F.lit(0).alias("_end"),
            F.col("_words").alias("_window"),
        ).filter(F.lit(False))
    hits = settle(found)
    rarity = hits.groupBy("_shingle").agg(F.count(F.lit(1)).alias("_n"))
    # A window with a shingle that no document has cannot occur.
    counted = shingles.join(rarity, "_shingle", "left")
    prefix = counted.groupBy("_window").agg(
        F.min_by(
            F.struct("_shingle", "_place"),
            F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_shingle", "_place"),
        ).alias("_rarest")
    )
    keyed = prefix.select("_window", "_rarest._shingle", "_rarest._place")
    fits = (F.col("_place") <= F.col("_back")) & (
        F.col("_back") - F.col("_place") + F.size("_window") <= F.size("_near")
    )
    same = (
        F.slice("_near", F.col("_back") - F.col("_place") + 1, F.size("_window"))
        == F.col("_window")
    )
    start = F.col("_at") - F.col("_place")
    return (
        hits.join(keyed, "_shingle")
        .filter(fits)
        .filter(same)
        .select(
            "_id", "_row", start.alias("_start"),
            (start + F.size("_window")).alias("_end"), "_window",
        )
    )


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window_words: int = WINDOW_WORDS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``items`` and ``contaminated`` to every document.

    A window is so many consecutive words of an item, or the whole item if it has fewer.
    ``n_hit`` counts the words inside occurrences of windows, ``items`` lists the ids of
    the items they come from as sorted strings, and a document is contaminated if at
    least a twentieth of its words is hit. Null, empty and wordless texts have no words
    and are clean; wordless items, and items without an id, have no windows. Rows without
    a document id are looked up too, by their text. Equal rows have equal results. All
    rows and columns are returned; columns named like the added ones are replaced. An
    empty table of documents or items gives no rows or no hits.
    """
    sealed, listed = Sealed.of(docs), Sealed.of(items)
    number, text = F.col(sealed.name(id_col)), F.col(sealed.name(text_col))
    item, item_text = listed.name(item_id_col), listed.name(item_text_col)
    windows = settle(
        item_windows(listed.frame.filter(F.col(item).isNotNull()), item, item_text, window_words)
    )
    # A struct compares null ids as equal.
    keyed = sealed.frame.withColumns({"_id": F.struct(number), "_row": F.xxhash64(text)})
    worded = keyed.select("_id", "_row", words_of(text).alias("_words"))
    spans = settle(contained_windows(worded, windows, window_words, block_shingles).distinct())
    ordered = Window.partitionBy("_id", "_row").orderBy("_start", "_end")
    reached = F.max("_end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(
        F.lit(0),
        F.col("_end") - F.greatest(F.col("_start"), F.coalesce(reached, F.lit(0))),
    )
    hit = (
        spans.select("_id", "_row", "_start", "_end").distinct()
        .withColumn("_fresh", fresh)
        .groupBy("_id", "_row")
        .agg(F.sum("_fresh").cast("long").alias("_hit"))
    )
    listed_items = (
        spans.select("_id", "_row", "_window").distinct()
        .join(windows, "_window")
        .groupBy("_id", "_row")
        .agg(F.sort_array(F.collect_set(F.col("_item").cast("string"))).alias("_items"))
    )
    result = keyed.withColumn("_n_words", count_words(text))
    result = result.join(hit, ["_id", "_row"], "left").join(listed_items, ["_id", "_row"], "left")
    n_hit = F.coalesce("_hit", F.lit(0).cast("long"))
    added = {
        "n_words": F.col("_n_words"),
        "n_hit": n_hit,
        "items": F.coalesce("_items", F.array().cast("array<string>")),
        "contaminated": (n_hit > 0) & (n_hit * 20 >= F.col("_n_words")),
    }
    return sealed.open(result, added)
