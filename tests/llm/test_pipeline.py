"""Stages on tables and on odd rows; each against what it promises for its own input."""

import corpus_pipeline as P
from quillstone.llm import neardup, pii


def test_every_stage_on_documents(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, small)
        if i < len(P.STAGES) - 1:
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before.collect(), docs.collect())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    before, after = seen["quality"]
    kept = {r["doc_id"] for r in after}
    known = [r["doc_id"] for r in before if r["doc_id"] in labels]
    assert sum((d in kept) == labels[d] for d in known) >= 0.95 * len(known)
    before, after = seen["near"]
    classes = {r["node"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(before)).collect()}
    assert sorted(r["doc_id"] for r in after) == sorted(set(classes.values()))
    before, after = seen["pii"]
    assert len(before) == len(after) and pii.find_pii(spark.createDataFrame(after)).selectExpr("sum(size(filter(pii, s -> s.kind <> 'secret')))").first()[0] == 0
    before, after = seen["mix"]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(texts[r["doc_id"]] == r["text"] for r in after)
    assert max(sum(x["doc_id"] == d for x in after) for d in texts) <= 3
    before, after = seen["encode"]
    assert len(before) == len(after) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in after)


def test_run_is_the_stages(spark, small):
    assert P.run(spark, small).count() > 0 and 4 <= len(P.STAGES) <= 5


def test_stages_on_odd_rows(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies string, score string, pii string, ids int"
    rows = [(1, "A clean line of words to keep here.", "en", "a", 5, "c", "s", "p", 1)] * 2 + [(None, None, None, None, None, None, None, None, None), (3, "", "en", "a", 0, "c", "s", "p", 1), (4, "Another clean line. " * 5000, "en", None, 1, None, None, None, 2)]
    for rows_ in (rows, []):
        docs = spark.createDataFrame(rows_, schema)
        for name, stage in P.STAGES:
            out = stage(spark, docs, small)
            got = out.collect()
            if name != "encode":
                assert out.columns == docs.columns
            if not rows_:
                assert got == []
