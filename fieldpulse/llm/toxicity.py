"""Toxicity by subword embeddings and a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of itself, a passage the
mean of its words, and a softmax over two classes reads the passage. Misspelt words share
most n-grams with the words they stand for. A text is as toxic as its most toxic passage,
in training and in scoring alike, so a few words count in a long text too. Since only the
difference of the two classes matters, scoring needs one number per n-gram.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.common import Sealed

# Labelled rows that are learnt from, at most, for each label: a bounded sample by the
# hash of the id. Everything else covers all rows.
SAMPLE_ROWS = {1: 2000, 0: 3000}
BUCKETS = 1 << 17
DIMENSIONS = 16
NGRAMS = (3, 4, 5)
# Words of a passage.
PASSAGE_WORDS = 16
BATCH_TEXTS = 32
EPOCHS = 10
RATE = 0.1
# Word scores that a task keeps.
CACHE_WORDS = 1_000_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased words; of a word repeated in a row, once, as it says nothing new."""
    found = _WORD.findall((text or "").lower())
    return [w for w, before in zip(found, ["", *found]) if w != before]


def subwords(word: str) -> list[int]:
    """Buckets of a word and of its n-grams of bytes, with marks for its ends."""
    marked = b"<%b>" % word.encode("utf-8", "surrogatepass")
    grams = [marked]
    for n in NGRAMS:
        grams += [marked[i : i + n] for i in range(len(marked) - n + 1)]
    return [h & (BUCKETS - 1) for h in map(zlib.crc32, grams)]


def worst_passage(scores: np.ndarray) -> tuple[int, int, float]:
    """Start, end and mean score of the passage with the highest mean; 0 without words."""
    n = len(scores)
    if n <= PASSAGE_WORDS:
        return 0, n, float(scores.mean()) if n else 0.0
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    means = (sums[PASSAGE_WORDS:] - sums[:-PASSAGE_WORDS]) / PASSAGE_WORDS
    at = int(means.argmax())
    return at, at + PASSAGE_WORDS, float(means[at])


@dataclass
class Model:
    """What scoring needs: a number per bucket, and the bias."""

    weights: np.ndarray
    bias: float

    def scorer(self):
        """Function from a text to its score, with a cache of word scores."""
        weights, cache = self.weights.tolist(), {}

        def of_word(word: str) -> float:
            value = cache.get(word)
            if value is None:
                ids = subwords(word)
                value = sum(map(weights.__getitem__, ids)) / len(ids)
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                cache[word] = value
            return value

        def of_text(text: str | None) -> float:
            found = words(text)
            scores = np.fromiter(map(of_word, found), np.float64, len(found))
            logit = worst_passage(scores)[2] + self.bias
            return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

        return of_text


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Train embeddings and softmax together, text by text on its worst passage.

    In the first epoch each text is taken as the set of its words, so that all of them
    have a vote before the model chooses a passage. Classes count alike. Without texts of both classes
    every text has the score of the known class by its count: below one half when no text is
    toxic, also when there is none at all, and one half for a single toxic text, as meant: one
    row is too little to speak for more.
    """
    y = np.asarray(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 2))))
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    tokens = [
        np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words(t)), np.int32)
        for t in texts
    ]
    flat, ends = array("i"), array("q", [0])
    for word in vocabulary:
        flat.extend(subwords(word))
        ends.append(len(flat))
    del vocabulary
    grams, starts = np.frombuffer(flat, np.int32), np.frombuffer(ends, np.int64)
    sizes = np.diff(starts)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares = np.full(BUCKETS, 1e-2, np.float32)
    softmax_squares = np.full((DIMENSIONS, 2), 1e-2, np.float32)
    bias_squares = np.full(2, 1e-2, np.float32)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    for epoch in range(EPOCHS):
        if epoch:
            per_gram = vectors @ (softmax[:, 1] - softmax[:, 0])
            per_word = np.add.reduceat(per_gram[grams], starts[:-1]) / sizes
            passages = [own[slice(*worst_passage(per_word[own])[:2])] for own in tokens]
        else:
            passages = [np.unique(own) for own in tokens]
        order = [i for i in rng.permutation(len(y)) if len(passages[i])]
        for first in range(0, len(order), BATCH_TEXTS):
            batch = np.array(order[first : first + BATCH_TEXTS])
            counts = np.array([len(passages[i]) for i in batch])
            chosen = np.concatenate([passages[i] for i in batch])
            flat = grams[_ranges(starts[chosen], sizes[chosen])]
            owner = np.repeat(np.repeat(np.arange(len(batch)), counts), sizes[chosen])
            share = np.repeat(1 / (sizes[chosen] * np.repeat(counts, counts)), sizes[chosen])
            passage = _sums(vectors[flat] * share[:, None], owner, len(batch))
            logits = passage @ softmax + bias
            shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = shifted / shifted.sum(axis=1, keepdims=True)
            error[np.arange(len(batch)), y[batch]] -= 1
            error *= weight[batch][:, None]
            # As if each n-gram carried its passage alone: the share would only scale the rate.
            used, place = np.unique(flat, return_inverse=True)
            step = _sums((error @ softmax.T)[owner], place, len(used))
            squares[used] += (step**2).mean(axis=1)
            vectors[used] -= RATE * step / np.sqrt(squares[used])[:, None]
            for value, square, slope in (
                (softmax, softmax_squares, passage.T @ error),
                (bias, bias_squares, error.sum(axis=0)),
            ):
                square += slope**2
                value -= RATE * slope / np.sqrt(square)
    return Model(
        (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0])
    )


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of consecutive ranges, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(before - starts, sizes)


def _sums(rows: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    return np.stack(
        [np.bincount(place, rows[:, d], n) for d in range(rows.shape[1])], axis=1
    ).astype(np.float32)


def held_out(number: Column) -> Column:
    """The fifth of rows that is never learnt from, by the id as text."""
    return F.coalesce(F.crc32(number.cast("string")) % 5 == 0, F.lit(True))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: dict[int, int] = SAMPLE_ROWS,
) -> Model:
    """Fit on a bounded sample of labelled rows that are not held out.

    Null ids and labels are left out; an id with several labels has the highest. Of rows
    that share an id, each text is learnt from.
    """
    texts, marks = Sealed.of(docs), Sealed.of(labels)
    number, text = texts.name(id_col), texts.name(text_col)
    marked, label = marks.name(id_col), marks.name(label_col)
    known = (
        marks.frame.filter(F.col(label).isin(0, 1) & ~held_out(F.col(marked)))
        .groupBy(F.col(marked).alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
    )
    ids = texts.frame.select(F.col(number).alias("_id")).distinct()
    present = known.join(ids, "_id", "left_semi").withColumn("_order", F.xxhash64("_id"))
    chosen = [
        present.filter(F.col("_label") == value).orderBy("_order", "_id").limit(rows)
        for value, rows in sample_rows.items()
    ]
    # As many rows as sample_rows says, so a broadcast.
    sample = chosen[0]
    for part in chosen[1:]:
        sample = sample.unionByName(part)
    rows = (
        texts.frame.select(F.col(number).alias("_id"), F.col(text).alias("_text"))
        .join(F.broadcast(sample), "_id")
        .groupBy("_id", "_label", F.xxhash64("_text").alias("_row"))
        .agg(F.first("_text").alias("_text"))
        .select(F.lit(0).alias("_all"), F.col("_id").cast("string"), "_label", "_row", "_text")
    )

    def learn(sampled: pa.Table) -> pa.Table:
        order = sampled.sort_by([("_label", "ascending"), ("_id", "ascending"), ("_row", "ascending")])
        done = fit(order.column("_text").to_pylist(), order.column("_label").to_pylist())
        held = [pa.array([done.weights.tobytes()], pa.binary()), pa.array([done.bias], pa.float64())]
        return pa.table(held, ["_weights", "_bias"])

    # The sample is bounded, so one task learns from it; the driver sees the weights alone.
    learnt = rows.groupBy("_all").applyInArrow(learn, "_weights binary, _bias double").first()
    if learnt is None:
        return fit([], [])
    return Model(np.frombuffer(learnt["_weights"], np.float32), learnt["_bias"])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``score``, from 0 to 1, higher for texts that are more likely toxic.

    Whole texts are scored, however long, and by nothing but the text, so repeated rows and
    equal texts score alike; null counts as empty, and texts without words have the score of no
    evidence. All rows and columns are returned; a column named ``score`` is replaced. An
    empty table gives an empty table.
    """
    sealed = Sealed.of(docs)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of_text = model.scorer()
        for texts in batches:
            yield pa.array((of_text(t.as_py()) for t in texts), pa.float64())

    return sealed.open(sealed.frame, {"score": scored(F.col(sealed.name(text_col)))})
