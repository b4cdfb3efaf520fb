import pytest
from helpers import apply, call, image, result
from pyspark.sql import functions as F

from scrollmill.functions.fileops import file_ops
from scrollmill.operators.exact import exact_dedupe
from scrollmill.operators.reads import referenced, superseded_reads
from scrollmill.schema import ExactOptions

NBSP = " "
#: (tool, arguments, operations)
CALLS = [
    ("ipython", {"code": "x = open('/a.txt').read()"}, ["r/a.txt"]),
    ("ipython", {"code": "open('/a.txt', 'r')"}, ["r/a.txt"]),
    ("ipython", {"code": 'open("/a.txt", "w").write(1)'}, ["w/a.txt"]),
    ("ipython", {"code": "Path('/a').read_text()"}, ["r/a"]),
    ("ipython", {"code": "Path('/a').write_text('b')"}, ["w/a"]),
    ("bash", {"command": "cat /etc/hosts"}, ["r/etc/hosts"]),
    ("bash", {"command": "echo 1 > /tmp/o"}, ["w/tmp/o"]),
    ("ipython", {"code": " \n%%bash\ncat /a >> /b"}, ["r/a", "w/b"]),
    ("edit", {"path": "/p", "edits": []}, ["w/p"]),
    ("browse", {"path": "/p"}, []),
    ("ipython", {"code": "print(1)"}, []),
    ("write_file", {"path": "/p"}, ["w/p"]),
    ("create_file", {"path": "/p"}, ["w/p"]),
    ("view", {"path": "/p"}, ["r/p"]),
    ("read_file", {"path": 7}, []),
    ("read", {}, []),
    ("bash", {"command": None}, []),
    ("ipython", {"code": "open('f', 'w+'); open('g', 'wb'); open(h, 'w'); open('i', mode='w')"}, ["rf", "wg", "ri"]),
    ("ipython", {"code": "Path('/b').write_bytes(x); open('/c'); Path( \"/a\" ) . read_bytes ( )"}, ["r/c", "r/a", "w/b"]),
    ("bash", {"command": "cat /a; tail -n 5 /b"}, ["r/a;"]),
    ("bash", {"command": "ls 2>/dev/null 2>&1\nhead -q /x && less -- -y"}, ["r/x", "w/dev/null", "w&1"]),
    ("bash", {"command": f"cat{NBSP}/a{NBSP}b >﻿/c"}, ["r/a", "w/c"]),
]


def test_file_operations(spark):
    import json

    rows = spark.createDataFrame([(i, tool, json.dumps(args)) for i, (tool, args, _) in enumerate(CALLS)], "i int, tool string, args string")
    got = {r["i"]: [o["kind"][0] + o["path"] for o in r["ops"]] for r in rows.select("i", file_ops(F.col("tool"), F.col("args")).alias("ops")).collect()}
    for i, (tool, args, want) in enumerate(CALLS):
        assert got[i] == want, (tool, args)


def read(call_id, path, text):
    return [call(call_id, code=f"open('{path}').read()"), result(call_id, text)]


def write(call_id, path):
    return [call(call_id, "edit", path=path, edits=[]), result(call_id, "edited")]


@pytest.fixture(scope="module")
def cases():
    mixed = [call("m", code="open('/a').read(); open('/a', 'w')"), result("m", "😀 both")]
    return {
        "stale": [*read("1", "/a", "old"), *write("2", "/a"), *read("3", "/a", "new")],
        "no write": [*read("1", "/a", "old"), *read("3", "/a", "old")],
        "no later read": [*read("1", "/a", "old"), *write("2", "/a")],
        "other path": [*read("1", "/a", "old"), *write("2", "/b"), *read("3", "/a", "old")],
        "three": [*read("1", "/a", "v1"), *write("2", "/a"), *read("3", "/a", "v2"), *write("4", "/a"), *read("5", "/a", "v3")],
        "mixed": [*mixed, *write("2", "/a"), *read("3", "/a", "new")],
        "image": [call("1", "view", path="/i"), result("1", "see", image("AAAA"), {"type": "odd"}), *write("2", "/i"), [*read("3", "/i", "new")][0], result("3", "new")],
        "no result": [call("1", code="open('/a')"), *write("2", "/a"), *read("3", "/a", "x")],
        "same id": [call("1", code="open('/b')"), call("1", code="print()"), result("1", "old"), *write("2", "/b"), *read("3", "/b", "x")],
        "circle": [*read("1", "/a", "same text " * 9), *write("2", "/a"), *read("3", "/a", "same text " * 9)],
    }


def stale(path, n):
    return [{"type": "text", "text": f"[stale: file{path} was modified after this read, see later read for current content — {n} chars elided]"}]


def test_superseded_reads(spark, cases):
    out = apply(spark, cases, superseded_reads)
    changed = {name: {i: m["content"] for i, m in enumerate(out[name]) if m != cases[name][i]} for name in cases}
    assert changed == {
        "stale": {1: stale(" (/a)", 3)}, "no write": {}, "no later read": {}, "other path": {}, "three": {1: stale(" (/a)", 2), 5: stale(" (/a)", 2)},
        "mixed": {1: stale("", 7)}, "image": {1: stale(" (/i)", len("see\n[image:image/png:4]\n"))}, "no result": {}, "same id": {2: stale(" (/b)", 3)}, "circle": {1: stale(" (/a)", 90)},
    }


def test_a_read_that_a_duplicate_refers_to_can_be_kept(spark, cases):
    one = {"circle": cases["circle"]}
    lost = apply(spark, one, lambda t: superseded_reads(exact_dedupe(t)))["circle"]
    assert "stale" in lost[1]["content"][0]["text"] and "identical" in lost[5]["content"][0]["text"]
    kept = apply(spark, one, lambda t: superseded_reads(exact_dedupe(t), referenced(t, ExactOptions())))["circle"]
    assert kept[1] == one["circle"][1]
