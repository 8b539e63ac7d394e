import random

import numpy as np
import pyarrow as pa

from fieldpulse.llm import substring_dedup as sub
from fieldpulse.llm import wordscan as scan
from fieldpulse.llm.shingles import find_words, rolling


def _texts():
    rng = random.Random(5)
    letters = "aAzZ09 _-.\n\t\x00\x7f\x80é  ßİ漢😀"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)]
    return [None, "", " ", "one", None, *made, "", "end"]


def test_words_are_those_of_the_pattern():
    for text in _texts():
        assert [w.decode() for w in scan.words(text)] == find_words(text)


def test_hashes_follow_words_whatever_the_pieces(monkeypatch):
    texts = [*_texts(), "x" * 5000, "y " * 5000, "é" * 3000 + " a"]
    for piece, group in ((1 << 18, 1 << 22), (64, 1000), (7, 1)):
        monkeypatch.setattr(scan, "SCAN_BYTES", piece)
        monkeypatch.setattr(scan, "GROUP_BYTES", group)
        known, seen = {}, 0
        # A slice of a column, so that its offsets do not begin at 0.
        column = pa.array(["cut off", *texts])[1:]
        for first, bounds, hashes in scan.hashed_texts(column):
            assert first == seen and bounds[-1] == len(hashes)
            for text, a, b in zip(texts[first:], bounds, bounds[1:]):
                found = find_words(text)
                assert len(found) == b - a
                for word, value in zip(found, hashes[a:b].tolist()):
                    assert known.setdefault(word, value) == value
                seen += 1
        assert seen == len(texts) and len(set(known.values())) == len(known)
    assert list(scan.hashed_texts(pa.array([], pa.string()))) == []


def test_least_places_are_the_rightmost_of_each_window():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 16, 40):
        values = rng.integers(0, 6, n, dtype=np.uint64)
        for window in (1, 3, 5, 16):
            want = [i + window - 1 - int(np.argmin(values[i : i + window][::-1])) for i in range(n - window + 1)]
            assert scan.least_places(values, window).tolist() == want


def test_seeds_of_texts_together_are_those_of_each():
    rng = np.random.default_rng(3)
    lengths = [0, 3, 50, 19, 20, 21, 0, 300, 49, 50]
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    hashes = rng.integers(0, 40, bounds[-1], dtype=np.uint64)
    for least in (1, 19, 20, 21, 50):
        keep, counts, places, found = sub.text_seeds(bounds, hashes, least)
        assert keep.tolist() == [i for i, n in enumerate(lengths) if n >= least]
        ends = np.cumsum(counts)
        for i, low, high in zip(keep, ends - counts, ends):
            own = rolling(hashes[bounds[i] : bounds[i + 1]], sub.SEED_WORDS)
            at = sub.minimizers(own, sub.SEED_WINDOW)
            assert places[low:high].tolist() == at.tolist()
            assert found[low:high].tolist() == own[at].tolist()
