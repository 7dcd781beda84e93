"""The pipeline's stages, each against brute force on its own input."""

import pytest

from tests.llm import test_decontamination, test_jaccard_join, test_line_dedup, test_packing, test_quality_classifier


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = test_quality_classifier.make(150, 4)
    clean = [t for i, t in docs if dict((a, b) for a, b, _ in labels).get(i) == 1]
    shared = "\n" + clean[0]
    docs += [(1000, clean[1]), (1001, clean[2] + " with an ending"), (1002, "Intro words of its own." + shared), (1003, "Other intro words." + shared)]
    item = clean[3]
    docs += [(1004, "before " + item + " after"), (1005, None), (1006, ""), (None, clean[4]), (1000, clean[1])]
    rows = [(i, t, "en", "s", None if t is None else len(t), k) for k, (i, t) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_key int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, item


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, folder):
    import corpus_pipeline

    path, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, docs, path))
        before, after = pairs(docs), None if name == "packing" else pairs(out)
        if name != "packing":
            assert out.columns == columns
        if name == "quality":
            assert set(after) <= set(before) and len(after) >= 0.6 * len(before)
        if name == "line_dedup":
            want = test_line_dedup.brute(before, 50)
            lines = lambda t: sum(bool(x.strip()) for x in (t or "").split("\n"))
            left = [(i, want[(i, t)][0] if t is not None else None) for i, t in before if not lines(t) or want[(i, t)][1] < lines(t)]
            assert after == sorted(left, key=str)
            assert all(r.n_chars == len(r.text) for r in out.collect() if r.text)
        if name == "near_copies":
            groups = test_jaccard_join.brute(before)
            empty = sum(n == 0 for _, n, _ in groups)
            assert len(after) == empty + len({c for _, n, c in groups if n})
        if name == "benchmark":
            assert after == [(i, t) for i, t in before if not test_decontamination.brute([(i, t)], [(1, item)], 0.75)]
            kept = before
        if name == "packing":
            test_packing.check(before, out.collect())
        docs = out
    assert kept


def test_run_equals_the_stages(spark, folder):
    import corpus_pipeline

    path, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0


def test_stages_take_small_batches(spark, monkeypatch):
    """A stage's tasks see batches of some MB, however many long texts a partition holds."""
    import corpus_pipeline
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": pa.array([batch.nbytes], pa.int64())})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "repeat('word ', 100000) as text")
    monkeypatch.setattr(corpus_pipeline, "_table", lambda *_: None)
    for module, function in [("quality_classifier", "keep_quality"), ("line_dedup", "clean_documents"), ("jaccard_join", "one_per_component"),
                             ("decontamination", "decontaminate"), ("packing", "pack_documents")]:
        monkeypatch.setattr(getattr(corpus_pipeline, module), function, lambda found, *_: found.mapInArrow(sizes, "size long"))
    before = spark.conf.get(name, None)
    try:
        for stage_name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(name)
            found = [r.size for r in stage(spark, docs, "").collect()]
            assert sum(found) >= 20_000_000 and max(found) < 8_000_000, stage_name
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
