import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import apply, call, image, result, texts
from pyspark.sql import functions as F

from scrollmill.functions.linediff import bag_similarity, diff_lines, render_diff
from scrollmill.operators import neardup
from scrollmill.operators.neardup import FEW, _pairs, _runs, best_candidates, near_dedupe, near_diffs, similar_pairs
from scrollmill.queries import QUERIES
from scrollmill.schema import NearOptions
from scrollmill.sources.tables import document_results

DATA = "/root/testdata/sf0.001"

STOCK = [f"{k:03d} | crate {k * 17 % 64} | weight {k * k % 97} kg" for k in range(48)]
EXTRA = "019b | barrel | weight unknown"
OLD, NEW = "\n".join(STOCK), "\n".join([*STOCK[:20], EXTRA, *STOCK[20:]])


def test_diff_rebuilds_the_new_text():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        ops = diff_lines(a, b)
        assert [x for k, x in ops if k != "add"] == a and [x for k, x in ops if k != "remove"] == b
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert sum(k == "equal" for k, _ in ops) == best[-1, -1]


def test_diffs_and_how_they_are_shown():
    assert diff_lines(["tea"], ["milk", "tea", "honey"]) == [("add", "milk"), ("equal", "tea"), ("add", "honey")]
    assert diff_lines(["salt", "rice", "oil"], ["rice"]) == [("remove", "salt"), ("equal", "rice"), ("remove", "oil")]
    assert diff_lines([], []) == [] and diff_lines(["one"] * 3, ["one"] * 3) == [("equal", "one")] * 3
    assert diff_lines(["up"], ["down"]) == [("remove", "up"), ("add", "down")]
    assert render_diff([("add", "p"), ("equal", "q"), ("remove", "r")]) == "+ p\n  q\n- r"
    before = [f"verse {k}" for k in range(30)]
    after = ["title", *before[:9], *before[10:], "coda"]
    assert render_diff(diff_lines(before, after)).split("\n") == [
        "+ title", "  verse 0", "  verse 1", "  ... (5 unchanged lines elided) ...", "  verse 7", "  verse 8", "- verse 9", "  verse 10", "  verse 11", "  ... (16 unchanged lines elided) ...", "  verse 28", "  verse 29", "+ coda",
    ]
    assert render_diff([("equal", x) for x in "wxyz"]) == "  w\n  x\n  y\n  z" and render_diff([]) == ""


def test_bag_similarity():
    assert bag_similarity(["sun", "moon"], ["moon", "sun"]) == 1 and bag_similarity(["sun"], ["moon"]) == 0 and bag_similarity([], []) == 1
    assert bag_similarity(["sun"] * 3 + ["moon"], ["sun", "moon", "moon", "star"]) == pytest.approx(1 / 2)


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 0.85, 1.0])
def test_pairs_agree_with_all_pairs(spark, threshold):
    rng = random.Random(4)
    rows = [(f"s{i % 2}", i, "\n".join(rng.choice(["", "}", "a", "b", "c", "d e"]) for _ in range(rng.randrange(1, 9)))) for i in range(90)]
    got = {(r["session_id"], r["ord"], r["cand"]): r["sim"] for r in similar_pairs(spark.createDataFrame(rows, "session_id string, ord int, text string"), threshold).collect()}
    want = {}
    for s, i, a in rows:
        for z, j, b in rows:
            sim = bag_similarity(b.split("\n"), a.split("\n"))
            if s == z and j < i and a != b and sim >= threshold:
                want[s, i, j] = sim
    assert got == want


def test_best_is_the_most_similar_then_the_earliest(spark):
    rows = [("s", 0, "a\nb\nc\nd"), ("s", 1, "a\nb\nc\ne"), ("s", 2, "a\nb\nc\nf"), ("s", 3, "a\nb\nc\nf\ng")]
    got = {r["ord"]: r["cand"] for r in best_candidates(spark.createDataFrame(rows, "session_id string, ord int, text string"), 0.5).collect()}
    assert got == {1: 0, 2: 0, 3: 2}


def test_near_duplicates(spark):
    code, other = OLD.replace("crate", "shelf"), "\n".join(f"nothing of the kind, {i * 11}" for i in range(48))
    changed = code.replace("007 | shelf", "007 | rack")
    long_old = "\n".join(f"entry {i}" for i in range(401))
    cases = {
        "listing": [call("c1", code="ls()"), result("c1", OLD), call("c2", code="ls()"), result("c2", NEW)],
        "equal": [result("c1", OLD), result("c2", OLD)],
        "unlike": [result("c1", OLD), result("c2", other)],
        "short": [result("c1", "a\nb\nc\nd\ne\nf\ng"), result("c2", "a\nb\nc\nd\ne\nf\nh")],
        "argument": [call("c1", code=code), result("c1", "x"), call("c2", code=changed), result("c2", "y")],
        "keys": [call("c1", code=code), call("c2", command=changed)],
        "equal argument": [call("c1", code=code), call("c2", code=code)],
        "numbers": [call("c1", code=code, timeout=30, verbose=True), call("c2", code=changed, timeout=30, verbose=True, z=None)],
        "siblings": [result("c1", OLD), result("c2", "keep", NEW, image("AAAA")), {"role": "assistant", "content": [{"type": "text", "text": "prose"}, {"type": "toolCall", "id": "c3", "name": "n", "arguments": {"10": code, "9": changed, "path": "/p"}}]}],
        "too long": [result("c1", long_old), result("c2", long_old + "\nmore")],
        "no cross": [call("c1", code=OLD), result("c1", NEW)],
    }
    out = apply(spark, cases, near_dedupe)
    for name in ("equal", "unlike", "short", "equal argument", "too long", "no cross"):
        assert out[name] == cases[name], name
    head, _, diff = texts(out["listing"][3])[0].partition("\n")
    assert head == "[near-duplicate of toolCallId c1 (99% similar), lossless line diff follows]" and out["listing"][1] == cases["listing"][1]
    assert diff == render_diff(diff_lines(OLD.split("\n"), NEW.split("\n"))) and f"+ {EXTRA}" in diff
    arg = lambda m, k="code": m["content"][-1]["arguments"][k]
    assert arg(out["argument"][2]).startswith("[near-duplicate of toolCall argument c1:code (98% similar), lossless line diff follows]\n")
    assert arg(out["keys"][1], "command").startswith("[near-duplicate of toolCall argument c1:code")
    assert out["numbers"][1]["content"][0]["arguments"] | {"code": 0} == {"code": 0, "timeout": 30, "verbose": True, "z": None}
    assert [b.get("text", "")[:10] for b in out["siblings"][1]["content"]] == ["keep", "[near-dupl", ""]
    # Array indices come first, by number: 9 is the base of 10.
    assert arg(out["siblings"][2], "9") == changed and arg(out["siblings"][2], "10").startswith("[near-duplicate of toolCall argument c3:9")
    strict = apply(spark, {"listing": cases["listing"]}, lambda t: near_dedupe(t, NearOptions(threshold=0.995)))
    assert strict["listing"] == cases["listing"]
    apart = apply(spark, {"argument": cases["argument"]}, lambda t: near_dedupe(t, NearOptions(min_arg_length=10**6)))
    assert apart["argument"] == cases["argument"]


def test_common_lines_hardly_join(spark):
    rows = [("s", i, "\n".join(["", "}", "{"] * 10 + [f"own {i} {k}" for k in range(40)])) for i in range(300)]
    corpus = spark.createDataFrame(rows, "session_id string, ord int, text string")
    assert similar_pairs(corpus, 0.85).count() == 0
    assert similar_pairs(corpus.withColumn("text", F.regexp_replace("text", "own [0-9]+", "own")), 0.85).count() == 0


def test_many_texts_that_share_lines(spark):
    """F1, F8, F11: of more than FEW texts with a line in common only those that their bitmaps leave make pairs."""
    rng = random.Random(8)
    rows = [("s", i, "\n".join([f"line {k}" for k in range(60) if rng.random() < 0.95] if i % 2 else [f"line {rng.randrange(60)}" for _ in range(60)])) for i in range(6 * FEW)]
    corpus = spark.createDataFrame(rows, "session_id string, ord int, text string")
    want = {(i, j) for _, i, a in rows for _, j, b in rows if j < i and a != b and bag_similarity(a.split("\n"), b.split("\n")) >= 0.85}
    assert {(r["ord"], r["cand"]) for r in similar_pairs(corpus, 0.85).collect()} == want
    met = _pairs(corpus, 0.85).count()
    assert len(want) <= met < 2 * len(want) < len(rows) ** 2 // 4


def test_texts_too_long_for_a_diff_are_not_looked_at(spark):
    """F1, F8, F11: they had their tokens exchanged."""
    rows = [("s", i, "\n".join(f"line {k}" for k in range(600 + i)), "r") for i in range(3)]
    corpus = spark.createDataFrame(rows, "session_id string, ord int, text string, ref string")
    seen = []
    keep, neardup._pairs = neardup._pairs, lambda *a: seen.append(a[0].count()) or keep(*a)
    try:
        assert near_diffs(corpus, NearOptions()).count() == 0 and seen == [0]
    finally:
        neardup._pairs = keep


def test_of_equal_texts_the_first_is_a_base(spark):
    """F8: each of many copies was a candidate of each."""
    lines = [f"row {k}" for k in range(40)]
    rows = [("s", i, "\n".join(lines if i % 3 else [*lines, f"more {i}"]), f"r{i}") for i in range(1, 4 * FEW)]
    corpus = spark.createDataFrame(rows, "session_id string, ord int, text string, ref string")
    got = {r["ord"]: r["ref"] for r in near_diffs(corpus, NearOptions()).collect()}
    assert {i for i in got} == {i for _, i, _, _ in rows if i % 3 == 0} | {i for _, i, _, _ in rows if i % 3 and i > 3}
    assert all(got[i] == ("r1" if i % 3 == 0 else "r3") for i in got)
    met = _pairs(corpus, 0.85, 400)
    assert met.where("ord % 3 > 0 and cand % 3 > 0").count() == 0 and met.where("cand % 3 > 0 and cand > 1").count() == 0


def test_a_first_token_that_fills_a_batch():
    """nothing is held before it, and no table without rows may come of that."""
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64())], ["token"]) for x in ([3, 3], [3, 3, 4], [5], [5, 6])]
    assert [(t.column("token").to_pylist(), s.tolist()) for t, s in _runs(iter(batches))] == [([3, 3, 3, 3], [0]), ([4], [0]), ([5, 5], [0]), ([6], [0])]


def test_diff_is_that_of_the_whole_table():
    """the table is made in parts, so that texts of any length can have a diff."""
    rng = random.Random(9)
    for k in range(200):
        a = [rng.choice("abcdefg"[: 1 + k % 7]) for _ in range(rng.randrange(60))]
        b = [rng.choice("abcdefg") for _ in range(rng.randrange(60))] if k % 2 else [x for x in a if rng.random() < 0.9]
        left = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                left[i, j] = left[i + 1, j + 1] + 1 if a[i] == b[j] else max(left[i + 1, j], left[i, j + 1])
        want, i, j = [], 0, 0
        while i < len(a) or j < len(b):
            kind = "add" if i == len(a) else "remove" if j == len(b) else "equal" if a[i] == b[j] else "remove" if left[i + 1, j] >= left[i, j + 1] else "add"
            want.append((kind, b[j] if kind == "add" else a[i]))
            i, j = i + (kind != "add"), j + (kind != "remove")
        assert diff_lines(a, b) == want


def _all_diffs(rows):
    """{(session, ord): (ref, sim, diff)} of rows (session, ord, text, ref), by plain loops and without a limit of lines."""
    out, lines = {}, [r[2].split("\n") for r in rows]
    for (s, i, a, _), x in zip(rows, lines, strict=True):
        near = [(-bag_similarity(y, x), j, ref, y) for (z, j, b, ref), y in zip(rows, lines, strict=True) if z == s and j < i and a != b]
        sim, _, ref, y = min(near, default=(0, 0, "", []))
        if -sim >= 0.85 and len((diff := render_diff(diff_lines(y, x))).encode()) < len(a.encode()):
            out[s, i] = ref, -sim, diff
    return out


def test_long_texts_have_diffs(spark):
    """texts of more than 400 lines had none, nor was one of 400 lines told of a longer one."""
    rows = [("s", i, "\n".join([f"line {k}" for k in range(390 + 10 * i)] + [f"own {i}"] * i), f"r{i}") for i in range(6)]
    rows += [("t", i, "\n".join(f"{'x' if k % 97 == i else 'word'} {k}" for k in range(3000)), f"t{i}") for i in range(3)]
    corpus = spark.createDataFrame(rows, "session_id string, ord int, text string, ref string")
    got = {(r["session_id"], r["ord"]): (r["ref"], r["sim"], r["diff"]) for r in near_diffs(corpus, NearOptions(max_diff_lines=None)).collect()}
    assert got == _all_diffs(rows) and set(got) == {(s, i) for s, i, _, _ in rows if i}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_near_dupe_diff_is_of_all_texts(spark):
    """the query over texts with a word a line had no diffs of those with more than 400 words."""
    docs = document_results(spark, DATA).select("session_id", "msg_idx", F.replace("text", F.lit(" "), F.lit("\n")), "tool_call_id").collect()
    rows = [tuple(r) for r in docs if r[2] is not None and len(r[2].encode()) >= 200]
    got = {(r["session_id"], r["ord"]): (r["ref"], r["sim"], r["diff"]) for r in QUERIES["near_dupe_diff"](spark, DATA).collect()}
    assert got == _all_diffs(rows)
    long = {(s, i) for s, i, a, _ in rows if a.count("\n") >= 400}
    assert long & set(got)
