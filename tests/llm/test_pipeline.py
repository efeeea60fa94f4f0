import corpus_pipeline
import numpy as np
from odd_rows import ODD
from test_simhash import slow_components, slow_simhash

from passagelake.llm import simhash
from passagelake.llm.queries import pipeline, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_the_stages_by_brute_force(spark):
    import sentencepiece

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i for i, r in docs.items() if any(c.isalpha() for c in r["text"] or "")}
    components = slow_components([(i, slow_simhash(docs[i]["text"])) for i in sorted(kept)])
    kept = {i for i in kept if components[i] == i}
    kept = {i for i in kept if not any(t in docs[i]["text"] for t in items)}
    rows = pipeline(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(kept)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for row in rows:
        source = docs[row["doc_id"]]
        assert all(row[c] == source[c] for c in corpus_pipeline.COLUMNS)
        assert row["token_ids"] == library.encode(source["text"]) and row["round_trip"]


def test_stages_on_odd_rows(spark, make_docs):
    docs = make_docs(ODD + [(30, "12 34")])
    language, near, clean, encoded = (stage for _, stage in corpus_pipeline.STAGES)
    kept = language(spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [3, 4, 5, 6, 7, 8, 8, 9, 10, 11, 12]
    unique = near(spark, kept, SF)
    ids = [r["doc_id"] for r in unique.collect()]
    assert len([i for i in ids if i in (8, 9)]) == 1 and {3, 4, 5, 6, 7, 10, 12} <= set(ids)
    rows = encoded(spark, clean(spark, unique, SF), SF).collect()
    assert len(rows) == len(ids) and all(len(r["token_ids"]) == r["n_tokens"] for r in rows)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
    assert np.all([c in empty.columns for c in corpus_pipeline.COLUMNS])


def test_exploded_keys_of_near_duplicates_are_not_broadcast(spark, make_docs, monkeypatch):
    """Spark sizes the 32 keys of a fingerprint like the fingerprint, so it would send them to the driver."""
    plans = []
    real = simhash.reliable

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(simhash, "reliable", kept)
    docs = make_docs([f"text {i // 2} of a number of texts" for i in range(40)])
    assert corpus_pipeline.near_duplicates(spark, docs, SF).count() == 20
    exploded = [p for p in plans if "Generate explode" in p]
    assert exploded and not any("Broadcast" in p for p in exploded)
