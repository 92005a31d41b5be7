import corpus_pipeline
import pytest
from blockloom.llm import queries


@pytest.fixture(scope="module")
def folder(labelled, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels = labelled
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_follow_one_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = stage(spark, docs, folder)
        assert docs_after.columns == docs.columns
        docs = spark.createDataFrame(docs_after.collect(), docs_after.schema)
        assert 0 < docs.count() < before or docs.count() == before
        before = docs.count()
    kept = {r.doc_id for r in docs.collect()}
    assert len(kept) == docs.count()
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == kept


def test_every_operator_is_registered():
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in queries.QUERIES) == 1
