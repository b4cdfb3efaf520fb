import random

from pyspark.sql import functions as F

from scrollmill.llm import common
from scrollmill.llm.line_dedup import fingerprints, mark_repeated_lines, op9_passage_dedup


def brute(rows, t):
    first = {}
    for i, text in rows:
        ls = (text or "").split("\n")
        for k in range(len(ls) - t + 1):
            w = tuple(ls[k : k + t])
            first[w] = min(first.get(w, (i, k)), (i, k))
    out = []
    for i, text in rows:
        ls = (text or "").split("\n")
        gone = {k + o for k in range(len(ls) - t + 1) if first[tuple(ls[k : k + t])] < (i, k) for o in range(t)}
        out.append((i, len(ls), len(gone), "\n".join(x for k, x in enumerate(ls) if k not in gone)))
    return sorted(out)


def run(docs, **options):
    return sorted((r["doc_id"], *r["__lines"]) for r in mark_repeated_lines(docs, **options).collect())


def test_lines_agree_with_brute_force(corpus, spark):
    docs, rows = corpus
    assert run(docs) == brute([(r[0], r[1]) for r in rows], 3)
    rng = random.Random(4)
    odd = [(i, "\n".join(rng.choice(["a", "b", "", "c c"]) for _ in range(rng.randrange(14)))) for i in range(80)]
    frame = spark.createDataFrame(odd, "doc_id long, text string")
    for gram, window in ((2, 2), (1, 4), (3, 3), (2, 1)):
        assert run(frame, gram=gram, window=window) == brute(odd, gram + window - 1)


def test_only_window_minima_leave_a_document(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, [f"l{rng.randrange(10**6)}" for _ in range(200)]) for i in range(20)], "id long, ls array<string>").withColumn("h", F.lit(0))
    for gram, window in ((2, 2), (1, 4), (3, 8)):
        grams = 20 * (200 - gram + 1)
        share = fingerprints(docs, gram, window).count() / grams
        assert abs(share - 2 / (window + 1)) < 0.05
    same = spark.createDataFrame([(1, ["a"] * 50)], "id long, ls array<string>").withColumn("h", F.lit(0))
    assert [r["runs"][-1]["start"] for r in fingerprints(same, 1, 4).orderBy(F.col("runs")[0]["start"]).collect()][:2] == [3, 4]  # the last of equal ones


def test_repeated_and_null_ids(spark):
    run = "p\nq\nr"
    rows = [(1, run + "\nx"), (2, "q\nr"), (2, "a\n" + run + "\nb"), (2, "a\n" + run + "\nb"), (None, "z\n" + run), (None, None), (2, "c\n" + run)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__lines": F.lit(1), "row": F.lit(2), "gone": F.lit(3), "h": F.lit(4), "id": F.lit(5)})
    out = mark_repeated_lines(docs)
    assert out.columns == ["doc_id", "text", "row", "gone", "h", "id", "__lines"]
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["__lines"]["n_lines"], r["__lines"]["n_removed"], r["__lines"]["kept"]) for r in out.collect())
    two = (2, f"a\n{run}\nb", 5, 3, "a\nb")
    assert got == [(0, "", 1, 0, ""), (0, "z\n" + run, 4, 0, "z\n" + run), (1, run + "\nx", 4, 3, "x"), two, two, (2, "c\n" + run, 4, 3, "c"), (2, "q\nr", 2, 0, "q\nr")]


def test_hot_lines_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    rows = [(i, "a\nb\nc\n" + ("d" if i % 3 else f"e{i}\na\nb\nc")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    join = common.join_split
    split = lambda *args: join(*args, least=5)
    monkeypatch.setattr("scrollmill.llm.line_dedup.join_split", split)
    assert run(docs) == brute(rows, 3)


def test_other_columns_and_no_rows(corpus, no_rows):
    docs, _ = corpus
    more = docs.withColumn("first", F.lit(1)).withColumn("start", F.lit(2)).withColumn("digest", F.lit("d"))
    out = mark_repeated_lines(more)
    assert out.columns == [*more.columns, "__lines"] and out.count() == docs.count()
    assert mark_repeated_lines(no_rows).count() == 0


def brute_passages(rows, t, least):
    """Every run that counts, however long."""
    first, runs = {}, []
    for i, text in rows:
        ls = (text or "").split("\n")
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                w = ls[a:b]
                if b - a >= t or sum(len(x.split()) for x in w) >= least or (b - a == len(ls) and w != [""]):
                    runs.append((i, a, b, tuple(w)))
                    first[tuple(w)] = min(first.get(tuple(w), (i, a)), (i, a))
    gone = {}
    for i, a, b, w in runs:
        if first[w] < (i, a):
            gone.setdefault(i, set()).update(range(a, b))
    split = [(i, (text or "").split("\n"), gone.get(i, set())) for i, text in rows]
    return sorted((i, len(ls), len(g), "\n".join(x for k, x in enumerate(ls) if k not in g)) for i, ls, g in split)


def test_long_passages_on_one_line_go(corpus, spark, tmp_path):
    rng = random.Random(9)
    lines = ["a b c d e", "b c d e f g", "a", "b", "", "c c"]
    odd = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for i in range(80)]
    frame = spark.createDataFrame(odd, "doc_id long, text string")
    for least in (1, 5, 6, 7):
        assert run(frame, least_words=least) == brute_passages(odd, 3, least)
    rows = [(r[0], r[1]) for r in dict.fromkeys(corpus[1]) if r[1] is None or r[1].count("\n") < 20]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert run(docs, least_words=51) == brute_passages(rows, 3, 51)
    got = {r["doc_id"]: r["n_removed"] for r in op9_passage_dedup(spark, str(tmp_path)).collect()}
    passage = [i for i, t in rows if t and t.count("\n") == 2 and len(t.split()) == 130]
    assert len(passage) == 12 and [got[i] for i in passage] == [0] + [1] * 11
