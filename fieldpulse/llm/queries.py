"""The registered queries of the corpus operators, with SQL where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.llm import (
    common,
    decontaminate,
    exact_dedup,
    lexical,
    line_dedup,
    neighbours,
    ngram_join,
    packing,
    pii,
    sharding,
    substring_dedup,
    toxicity,
    warc,
    whitening,
)
from fieldpulse.llm.common import LOWER, UPPER, table


def _hex(digest: str):
    return F.lower(F.hex(digest))


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    text = F.col("text")
    # Narrow and read several times, so written once.
    rows = common.settle(
        docs.select(
            "doc_id",
            sharding.text_bytes(text).alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        )
    )
    done = sharding.shard_rows(rows, "digest", "size", "doc_id")
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = decontaminate.find_contamination(docs, table(spark, folder, "benchmark"))
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs)
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return done.select("doc_id", "n_lines", "n_dropped", kept)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    digest = common.text_digest(common.ascii_lower(F.col("text")))
    prints = common.settle(docs.select("doc_id", digest.alias("digest")))
    done = exact_dedup.exact_dedup(prints, "digest", "doc_id")
    return done.select(
        "doc_id", "keep_id", "group_size", "kept", _hex("digest").alias("text_sha256")
    )


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substring_dedup.shared_passages(docs).withColumnRenamed("ref_id", "ref_doc_id")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    files = [public_tokenizers.path(f"byte_bpe_50k.{form}") for form in ("json", "tiktoken")]
    pieces = packing.tokenize_pieces(docs, "doc_id", "text", *files)
    return packing.pack_pieces(pieces)


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    files = warc.write_archives(table(spark, folder, "pages").select("page_id", "url", "html"))
    records = warc.read_archives(files, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ngram_join.near_duplicates(docs).drop("text")


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find_pii(docs).drop("text")

    def count(kind: str):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id", *[count(k) for k in pii.BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"),
    )


def op11_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return neighbours.nearest_neighbours(rows, "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    done = whitening.whiten(table(spark, folder, "embeddings"), "vec_id", "embedding")
    # Beyond a long (some 400,000 rows of this spread) the exact value is the operator's decimal.
    return done.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_ngram_join": op9_ngram_join,
    "op10_pii": op10_pii,
    "op11_neighbours": op11_neighbours,
    "op12_whitening": op12_whitening,
    "op13_lexical": op13_lexical,
}

_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER
    + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), {decontaminate.WINDOW_WORDS}) - 1) AS win
  FROM (SELECT item_id, w,
    unnest(range(1, len(w) - least(len(w), {decontaminate.WINDOW_WORDS}) + 2)) AS i
    FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS k FROM windows),
grams AS (
  SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, i, k, item_id FROM grams JOIN windows USING (win)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '{UPPER}', '{LOWER}') AS key FROM lines),
marked AS (
  SELECT *, length(key) >= {line_dedup.LEAST_CHARS}
    AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), ''))
    AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""",
    "op8_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS top, strlen(t) AS n FROM p)
SELECT page_id, n AS payload_bytes, sha1(t) AS payload_digest,
  CASE WHEN n >= {warc.LEAST_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN n >= {warc.LEAST_BYTES} AND page_id <> top THEN top END AS refers_to
FROM g""",
    "op11_neighbours": f"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(
    list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= {neighbours.NEAREST}""",
    "op13_lexical": f"""
WITH d AS (
  SELECT doc_id, len(w) AS n, w FROM (SELECT doc_id, {_SQL_WORDS} AS w FROM documents) WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d)
  GROUP BY doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_SQL_WORDS}) AS term FROM benchmark),
s AS (
  SELECT item_id, doc_id, CAST(sum(
    CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // words))))) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) CROSS JOIN total GROUP BY item_id, doc_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n
  FROM s WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM r WHERE n <= {lexical.TOP}""",
}
