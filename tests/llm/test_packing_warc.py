import gzip
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldpulse.llm import packing, queries, warc

FILES = [public_tokenizers.path(f"byte_bpe_50k.{form}") for form in ("json", "tiktoken")]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_op7_equals_the_tokenizer_and_fills_sequences(spark, folder, tokenizer):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op7_packing(spark, folder).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.length for r in pieces[1:]] == [2048] * (len(pieces) - 1)
        at = 0
        for r in pieces:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 2048) + 1


def test_encoder_equals_the_tokenizer_on_odd_texts(tokenizer):
    rng = random.Random(5)
    pieces = ["a", " ", "  ", "\n", "\t", "'s", "'", "é", "😀", "日本", "１", "½", "<|endoftext|>", "\x00", "​", "́", "ǅ", "A1", "..."]
    pieces += [chr(c) for c in range(0x250)] + ["\x85", "\u2028", "\u1680", "ا", "ж"]
    encode = packing.encoder(*FILES)
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("blank", [" ", "\t", "\n"])
def test_very_long_blanks_and_special_tokens(spark, blank, tokenizer):
    texts = [blank * 2_000_000, "end <|endoftext|> of", "a" * 30_000 + "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = packing.tokenize_pieces(df, "id", "text", *FILES, keep_ids=True).orderBy("id", "piece").collect()
    for number, text in enumerate(texts):
        ids = [i for r in rows if r.id == number for i in r.ids]
        assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert [i for r in rows if r.id == 1 for i in r.ids] == [437, 220, 50256, 286, 0]


def test_pieces_of_odd_rows(spark):
    rows = [(1, "a b", 5), (1, "a b", 5), (None, None, 6), (2, "", 7)]
    df = spark.createDataFrame(rows, "id long, text string, length int")
    got = sorted(packing.tokenize_pieces(df, "id", "text", *FILES).select("id", "piece", "length").collect(), key=repr)
    assert [tuple(r) for r in got] == [(1, 0, 3), (1, 0, 3), (2, 0, 1), (None, 0, 1)]
    assert packing.tokenize_pieces(df.limit(0), "id", "text", *FILES).collect() == []
    with pytest.raises(ValueError):
        packing.tokenize_pieces(df, "Length", "text", *FILES)


def test_every_capacity_holds():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 200, 800)
    for score in ("norm", "dot"):
        for caps in ((200, 200, 200**2), (200, 3, 200**2), (200, 50, 40_000), (250, 4, 45_000)):
            sequence, offset = packing.best_fit(lengths, caps, score=score)
            for s in set(sequence):
                own = np.flatnonzero(sequence == s)
                assert lengths[own].sum() <= caps[0] and len(own) <= caps[1]
                assert (lengths[own] ** 2).sum() <= caps[2]
                own = own[np.argsort(offset[own])]
                assert list(offset[own]) == [0, *np.cumsum(lengths[own])[:-1]]
    least = -(-lengths.sum() // 200)
    assert len(set(packing.best_fit(lengths, (200, 200, 40_000))[0])) <= 1.02 * least


def test_piece_lengths():
    assert packing.piece_lengths(5, 5) == [5]
    assert packing.piece_lengths(10, 5) == [5, 5]
    assert packing.piece_lengths(11, 5) == [1, 5, 5]


def test_pack_repeated_rows_names_and_empty(spark):
    rows = [(None, 3, "a")] * 5 + [(1, 5, "b")]
    df = spark.createDataFrame(rows, "_tag long, length long, offset string")
    done = packing.pack_pieces(df, max_tokens=6, block_pieces=2).collect()
    assert len(done) == 6 and {r.length for r in done} == {3, 5}
    assert packing.pack_pieces(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack_pieces(df, max_tokens=4)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    kept = packing.tokenize_pieces(docs, "doc_id", "text", *FILES, max_tokens=2, keep_ids=True).collect()
    assert [(r.doc_id, r.piece, len(r.ids)) for r in kept] == [(1, 0, 1), (2, 0, 1), (3, 0, 1), (3, 1, 2)]


def _pages():
    big = "x" * 1200
    return [
        (1, "http://a", big), (2, "http://b", big), (3, None, "y" * 999), (4, "u", "y" * 999),
        (5, "v w", None), (6, "", ""), (7, "z", "é" * 500), (8, "z", "é" * 500), (None, "n", big),
        (9, "m", "\r\n\r\nWARC/1.0\r\n" * 200),
    ]


@pytest.mark.parametrize("split", [64, 300, 1 << 20])
def test_archives_round_trip(spark, split):
    df = spark.createDataFrame(_pages(), "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(df.withColumn("_payload", F.lit(3)))
    rows = {r.page_id: r for r in warc.read_archives(files, split).collect()}
    assert len(rows) == 10
    for page, url, html in _pages():
        r = rows[page]
        assert r.payload_bytes == len((html or "").encode()) and r.url == (url or "")
        if r.record_type == "response":
            assert r.payload.decode() == (html or "")
        else:
            assert r.payload is None
    assert {p: r.refers_to for p, r in rows.items() if r.record_type == "revisit"} == {1: 2, None: 2, 7: 8}
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_reader_is_not_misled_by_archives_in_payloads():
    rng = random.Random(2)
    inner = b"".join(warc.format_record(i, "in", bytes(rng.randbytes(300)), None, False) for i in range(40))
    outer = []
    for i in range(30):
        payload = inner if i % 5 == 0 else rng.randbytes(rng.randrange(3000))
        outer.append(warc.format_record(i, "out", payload, None, False))
    data = b"".join(outer)
    assert gzip.decompress(data).count(b"urn:page") >= 30
    for split in (500, 4096, 30_000, len(data)):
        got = []
        for start in range(0, len(data), split):
            part = warc.records_in(io.BytesIO(data), len(data), start, start + split)
            got += [warc.parse_record(r)["page_id"] for r in part]
        assert got == list(range(30)), split


def test_damaged_record_raises():
    data = warc.format_record(1, "u", b"abc" * 50, None, False)
    with pytest.raises(ValueError):
        list(warc.records_in(io.BytesIO(data[:-3] + b"\0\0\0"), len(data), 0, len(data)))


