import corpus_pipeline as c
from test_exact_dedup import brute as exact
from test_minhash_dedup import brute as near


def test_each_stage_does_what_it_says(spark, corpus, tmp_path):
    docs, rows = corpus
    docs.dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    docs = start = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (_, stage) in enumerate(c.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(c.STAGES) - 1:
            assert docs.columns == start.columns
            docs.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
    first = [(r["doc_id"], r["text"]) for r in seen[0]]
    assert {i for i, _ in first} == {r[0] for r in rows if r[1] and any(map(str.isalpha, r[1]))}
    left = {r[0] for r in exact(first) if r[3]}
    assert {r["doc_id"] for r in seen[1]} == left
    second = [(i, t) for i, t in first if i in left]
    assert {r["doc_id"] for r in seen[2]} == {r[0] for r in near(second, 80) if r[3]}
    assert {r["doc_id"] for r in seen[3]} <= {r["doc_id"] for r in seen[2]}
    assert sorted(r["doc_id"] for r in seen[4]) == sorted(r["doc_id"] for r in seen[3])
    assert sorted(map(tuple, c.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, seen[4]))


def test_no_rows(spark, no_rows, tmp_path):
    no_rows.write.parquet(str(tmp_path / "documents.parquet"))
    assert c.run(spark, str(tmp_path)).count() == 0
