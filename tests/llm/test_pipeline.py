import corpus_pipeline
from recordloom.llm.queries import QUERIES


def test_stages_run_in_order_and_take_effect(spark, documents):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    docs, folder = documents, "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == documents.columns, name
    assert docs.count() > 0


def test_stages_take_odd_and_empty_documents(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "/root/testdata/sf0.001").collect()


def test_every_operator_is_registered():
    assert sorted(int(key[2:].split("_")[0]) for key in QUERIES) == list(range(1, 11))
