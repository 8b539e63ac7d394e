"""The pipeline, stage by stage, against plain Python on the small table."""

import corpus_pipeline
from fieldpulse.llm.common import settle
from tests.llm.test_dedup import _contamination, _lines_kept
from tests.llm.test_toxicity_ngram import brute_classes


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"
    ]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = [{r.doc_id: r for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, folder))
        if stage is not corpus_pipeline.pack:
            assert docs.columns == corpus_pipeline.COLUMNS
            kept.append({r.doc_id: r for r in docs.collect()})
            assert len(kept[-1]) == docs.count()
    before, calm, lines, single, clean = kept
    # Texts of the rows that stay are untouched, and most stay.
    assert all(calm[d] == before[d] for d in calm) and len(calm) > 0.8 * len(before)
    want = {d: t for d, t, _, _ in _lines_kept([(d, r.text) for d, r in calm.items()])}
    assert {d: r.text for d, r in lines.items()} == want
    assert all(r.n_chars == len(r.text) for d, r in lines.items() if r.text != calm[d].text)
    classes, _ = brute_classes({d: r.text for d, r in lines.items()})
    assert single == {d: r for d, r in lines.items() if classes[d] == d}
    judged = _contamination([(d, r.text) for d, r in single.items()], items)
    assert clean == {d: single[d] for d, _, _, _, bad in judged if not bad}
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(clean)
    assert all(0 <= r.offset and r.offset + r.length <= 2048 for r in rows)


def test_run_takes_an_empty_and_an_odd_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i}" for i in range(40))
    odd = [(1, text, "en", "a", 5), (None, None, None, None, None), (2, text, None, None, 1),
           (2, text, None, None, 1), (3, "", "x", "y", 0)]
    for name, rows in (("empty", []), ("odd", odd)):
        where = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(str(where / "documents.parquet"))
        spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").write.parquet(str(where / "labels.parquet"))
        spark.createDataFrame([(7, "none of these")], "item_id long, text string").write.parquet(str(where / "benchmark.parquet"))
        found = corpus_pipeline.run(spark, str(where)).collect()
        assert bool(found) == bool(rows)
    assert {r.doc_id for r in found} >= {1, None, 3}


def test_documents_stay_when_no_toxic_row_is_known(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(d, " ".join(f"word{d}x{i}" for i in range(40)), "en", "a", 5) for d in range(10)]
    docs = spark.createDataFrame(rows, schema)
    for name, labels, stay in (("none", [], 10), ("clean", [(d, 0) for d in range(10)], 10), ("toxic", [(d, 1) for d in range(10)], 0)):
        where = tmp_path / name
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(where / "labels.parquet"))
        assert corpus_pipeline.drop_toxic(spark, docs, str(where)).count() == stay
