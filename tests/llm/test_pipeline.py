"""The pipeline's stages on the messy table."""

import corpus_pipeline
from trafficlens.llm import quality
from trafficlens.llm.common import stored


def test_stages(spark, messy, data):
    docs = messy
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, data), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == messy.columns
        if name.startswith("quality"):
            model = quality.learn(messy, spark.read.parquet(f"{data}/labels.parquet"))
            scores = quality.scored(messy, model, score="_s").collect()
            assert docs.count() == sum(r._s >= quality.FLOOR for r in scores)
        if name.startswith("MinHash"):
            ids = {r.doc_id for r in docs.collect()}
            kept = {r.doc_id for r in before.collect()}
            assert not ({9, 10} <= ids) and (9 in ids or 9 not in kept)
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_contaminated_rows_go_by_row(spark, messy, data):
    """A contaminated document without an id goes, a clean one that shares its id with a contaminated one stays."""
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").select("text").collect() if len((r.text or "").split()) > 20]
    rows = [(None, items[0]), (None, "clean and without an id"), (1, items[0]), (1, "clean with the same id"), (2, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, number string")
    got = corpus_pipeline.drop_contaminated(spark, docs, data)
    assert got.columns == docs.columns
    assert {tuple(r)[:2] for r in got.collect()} == {rows[1], rows[3], rows[4]}


def test_empty(spark, messy, data):
    docs = messy.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, data), "test")
        assert docs.count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert {"op4_exact_dedup", "op7_decontamination", "op11_ranked_search", "op13_prefix_trie"} <= set(entry.oracle_sql())
