"""The pipeline against its stages one by one, and its queries' columns."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from quern.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage keeps, as the driver runs them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(spark, kept):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert all(d.columns == first.columns for d in kept[:-1])
    sizes = [first.count(), *(d.count() for d in kept)]
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] >= sizes[4] > 0
    ids = {r.doc_id for r in kept[3].select("doc_id").collect()}
    assert {r.doc_id for r in kept[4].select("doc_id").collect()} == ids
    assert kept[1].where("n_chars != length(text)").count() == first.join(kept[1].select("doc_id"), "doc_id").where("n_chars != length(text)").count()


def test_run_equals_stages(spark, kept):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    run = corpus_pipeline.run(spark, SF).select(*columns)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, kept[4].select(*columns).collect()))
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_operator_has_one_query():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
