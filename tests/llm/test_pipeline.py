"""The pipeline against brute force over its own stages' inputs."""

from trialspark.llm import language_id, pii
from trialspark.llm.common import scratch_path

from .test_basic_ops import brute_lines, check_sequences
from .test_more_ops import brute_groups

SF = "/root/testdata/sf0.001"


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", None, "s", 0), (-3, "#### 123", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        path = scratch_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS) and len({r.doc_id for r in rows}) == len(rows)
        after = {r.doc_id: r for r in rows}
        if name == "language_id":
            assert set(before) - set(after) == {-1, -2, -3}
            assert all(after[d].text == before[d].text for d in after)
        elif name == "line_dedup":
            assert set(after) == set(before)
            import hashlib

            want = {d: sha for d, _, _, sha in brute_lines([(d, r.text) for d, r in before.items()], 10)}
            assert {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in after.items()} == want
        elif name == "jaccard_join":
            groups = brute_groups([(d, r.text) for d, r in before.items()])
            assert set(after) == {d for d, (_, c) in groups.items() if c == d} and len(after) < len(before)
        elif name == "personal_data":
            assert set(after) == set(before)
            for d, r in before.items():
                (base, more), = pii.all_spans([r.text], *pii.model())
                assert after[d].text == pii.redact(r.text, base + more) and after[d].n_chars == len(after[d].text)
                assert not pii.base_spans(after[d].text)
        else:
            assert {r.doc_id for r in rows} == set(before)
            check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    assert language_id.MIN_SCORE == 0.5


def test_run_is_registered(spark):
    import __spark_entry__
    import corpus_pipeline

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_repeated_rows_empty_tables_and_clashing_columns(spark):
    """Repeated doc_ids (same and other texts), null columns, columns that the stages' own work is named like, and no rows at all."""
    import corpus_pipeline

    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = spark.createDataFrame([(0, None, None, None, None), (0, None, None, None, None), (None, "The the of and. Odd line\n" * 3, "en", "s", 1), (7, "another text of one id", "en", "s", 1)], base.schema)
    docs = base.unionByName(base.limit(20)).unionByName(more)
    for name in ("n_lines", "n_dropped", "lang_pred", "score", "component_id", "n_shingles", "spans", "base", "n_email", "ids", "piece", "start", "_cut", "_rank", "_text", "length", "key", "node", "held_out"):
        docs = docs.withColumn(name, docs["doc_id"].cast("string"))
    n = docs.count()
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows[name] = out.collect()
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, docs.limit(0), SF).count() == 0
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert len(rows["line_dedup"]) == len(rows["personal_data"]) == n and sorted(map(key, rows["line_dedup"])) == sorted(map(key, docs.select("doc_id").collect()))
    assert 0 < len(rows["language_id"]) < n and all(r.text for r in rows["language_id"])
    kept = [r.doc_id for r in rows["jaccard_join"]]
    assert kept.count(7) == 2 and len(kept) < n and kept.count(None) == 1  # rows of one doc_id are told apart by their texts
    check_sequences([(r.sequence_id, r.offset, r.length) for r in rows["packing"]], 4096)
    assert sum(r.piece == 0 for r in rows["packing"]) == n
