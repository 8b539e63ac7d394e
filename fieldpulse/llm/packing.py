"""Best-fit packing of documents into token sequences.

Documents become pieces of at most so many tokens. Pieces are packed with three
capacities at once: tokens, number of documents, and attention cost (the sum of squared
lengths). Pieces are dealt at random into blocks of bounded size that are packed side by
side; in a block the longest pieces go first, and each goes to the open sequence that has
room in every capacity and fits best.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.common import Sealed, settle

MAX_TOKENS = 2048
# The id that ends each document.
END_ID = 0
# Pieces packed together in one task.
BLOCK_PIECES = 20_000
# Weights of residual tokens, documents and attention cost.
WEIGHTS = (1.0, 0.05, 0.05)
# Texts that are encoded before their pieces are handed on.
_TEXTS_AT_ONCE = 64
# Fixed value: how this family of tokenizers splits a text before merging.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


# The quick form is only for texts of letters up to here, where all tables of character kinds
# agree, and without long blanks, on which its pattern engine gives up.
_UNSURE = re.compile("[^\x00-\u024f]")
_BLANKS = re.compile(r"\s{1000}")


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str, ranks_path: str | None = None):
    """Function from a text to its ids as the tokenizer file has them.

    With a file of ranks of the same vocabulary, plain texts take a quicker way to the same
    ids. Special tokens that stand in a text are special, as by the tokenizer's default.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)

    def whole(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if ranks_path is None:
        return whole
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [token.content for token in tokenizer.get_added_tokens_decoder().values()]

    def either(text: str) -> np.ndarray:
        odd = not text.isascii() and _UNSURE.search(text)
        if odd or any(token in text for token in special) or _BLANKS.search(text):
            return whole(text)
        return quick.encode_to_numpy(text)

    return either


def piece_lengths(tokens: int, most: int) -> list[int]:
    """A document is cut only if it is too long; the first piece takes what is left over."""
    if tokens <= most:
        return [tokens]
    short = [tokens % most] if tokens % most else []
    return short + [most] * (tokens // most)


_PIECE_TYPES = "piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    tokenizer_path: str,
    ranks_path: str | None = None,
    max_tokens: int = MAX_TOKENS,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, its ids.

    Null counts as empty; an empty text is the end id alone. Whole texts are encoded,
    however long. Repeated rows and null ids have pieces of their own each; an empty table
    gives an empty table. Other columns are not read, and the id column cannot have the name
    of an added one. Both files must exist on every executor.
    """
    added = ["piece", "start", "length", "ids_crc32", "ids"]
    if id_col.lower() in added:
        raise ValueError(f"the id column cannot be named {id_col!r}")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                part = batch.slice(at, _TEXTS_AT_ONCE)
                rows, out = [], {c: [] for c in ("piece", "start", "length", "ids_crc32", "ids")}
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(encode(text or ""), END_ID).astype("<u4")
                    start = 0
                    for piece, length in enumerate(piece_lengths(len(ids), max_tokens)):
                        own = ids[start : start + length]
                        rows.append(row)
                        out["piece"].append(piece)
                        out["start"].append(start)
                        out["length"].append(length)
                        out["ids_crc32"].append(zlib.crc32(own.tobytes()))
                        if keep_ids:
                            out["ids"].append(own.astype("int32"))
                        start += length
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(out["piece"], pa.int32())]
                columns += [pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, {_PIECE_TYPES}" + (", ids array<int>" if keep_ids else "")
    return docs.select(id_col, text_col).mapInArrow(pieces, schema)


def best_fit(
    lengths: np.ndarray,
    capacities: tuple[float, float, float],
    weights: tuple[float, float, float] = WEIGHTS,
    score: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of one block.

    ``score`` is "norm", the weighted norm of what stays free, which is kept small, or
    "dot", the weighted product of what the piece needs and what is in use, kept large.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    caps = np.asarray(capacities, dtype=np.float64)
    weight = np.asarray(weights, dtype=np.float64)
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if n else 0
    free = np.empty((n, 3))
    open_ids = np.empty(n, np.int64)
    used = np.zeros(n, np.int64)
    n_open = n_all = 0
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        room = free[:n_open]
        fits = np.flatnonzero((room >= need).all(axis=1))
        if len(fits):
            if score == "norm":
                value = (((room[fits] - need) / caps) ** 2) @ weight
                best = fits[np.argmin(value)]
            else:
                value = ((1 - room[fits] / caps) * (need / caps)) @ weight
                best = fits[np.argmax(value)]
        else:
            best = n_open
            free[best], open_ids[best] = caps, n_all
            n_open, n_all = n_open + 1, n_all + 1
        chosen = open_ids[best]
        sequence[i], offset[i] = chosen, used[chosen]
        used[chosen] += lengths[i]
        free[best] -= need
        if (free[best] < (least, 1.0, float(least) ** 2)).any():  # nothing fits any more
            n_open -= 1
            free[best], open_ids[best] = free[n_open], open_ids[n_open]
    return sequence, offset


def pack_pieces(
    pieces: DataFrame,
    length_col: str = "length",
    max_tokens: int = MAX_TOKENS,
    max_documents: int | None = None,
    max_cost: int | None = None,
    score: str = "norm",
    block_pieces: int = BLOCK_PIECES,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every piece.

    Lengths are 1 to ``max_tokens``. Without ``max_documents`` and ``max_cost`` these two
    capacities are wide enough never to bind; a piece that alone exceeds ``max_cost``
    raises. All rows and columns are returned; columns of the added names are replaced.
    Equal rows are packed one by one. An empty table gives an empty table. Larger tables
    are packed in more blocks, each of which leaves about one sequence unfilled.
    """
    caps = (max_tokens, max_documents or max_tokens, max_cost or max_tokens**2)
    sealed = Sealed.of(pieces)
    length = sealed.name(length_col)
    # The tag is drawn once and written, so that a repeated task deals out alike.
    rows = settle(sealed.frame.withColumn("_tag", F.monotonically_increasing_id()))
    n, longest = rows.agg(F.count(F.lit(1)), F.max(length)).first()
    if n and (longest > max_tokens or longest**2 > caps[2]):
        raise ValueError(f"a piece of {longest} tokens fits no sequence")
    blocks = max(1, -(-n // block_pieces))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_tag", ignore_index=True)
        sequence, offset = best_fit(block[length].to_numpy(), caps, score=score)
        return pd.DataFrame(
            {
                "_tag": block["_tag"],
                "_sequence": block["_block"].to_numpy().astype(np.int64) * (1 << 32) + sequence,
                "_offset": offset,
            }
        )

    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("_tag"), F.lit(blocks)))
    narrow = dealt.select("_tag", "_block", length)
    placed = narrow.groupBy("_block").applyInPandas(
        pack, "_tag long, _sequence long, _offset long"
    )
    return sealed.open(
        rows.join(placed, "_tag"),
        {"sequence_id": F.col("_sequence"), "offset": F.col("_offset")},
    )
