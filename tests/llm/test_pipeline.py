import corpus_pipeline as pipeline
from millrace.llm import near_copies

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == columns, name
        docs = docs.checkpoint()
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        ids = now
    texts = [r.text for r in docs.select("text").collect()]
    lowered = [x.encode().lower() for x in texts]
    assert len(set(lowered)) == len(lowered)
    sets = [near_copies.shingles(x.encode()) for x in texts]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    encoded = pipeline.run(spark, DIR)
    assert {r.doc_id for r in encoded.select("doc_id").collect()} == ids
