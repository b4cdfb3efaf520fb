import json
import random
import re

import pytest
from helpers import apply, image, result, texts, user
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrollmill.functions import jsjson
from scrollmill.functions.text import js_trim, json_string_len, utf16_len
from scrollmill.operators.minify import minify
from scrollmill.operators.runs import collapse_blank, collapse_runs, runlength, strip_trailing

RUNS = {
    "ok\nok\nok\ndone": "ok (×3)\ndone", "a\na": "a\na", "\n".join(["r"] * 10): "r (×10)", "a\na\na\nb\nc\nc\nc\nc": "a (×3)\nb\nc (×4)", "x\ny": "x\ny", "": "",
    "a\n\n\n\nb": "a\n (×3)\nb", "h\nh\nh\nh\n": "h (×4)\n", "\n\n": " (×3)", "a\nab\nab": "a\nab\nab", "ab\nb\nb\nb": "ab\nb (×3)", "a\r\na\r\na\r\nb": "a\r (×3)\nb",
}


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", f(F.col("t")).alias("x"))
    return [r["x"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_runs(spark):
    assert column(spark, list(RUNS), collapse_runs) == list(RUNS.values())


def test_runs_agree_with_a_plain_loop(spark):
    rng = random.Random(1)
    values = ["\n".join(rng.choice(["", "a", "b", "aa"]) for _ in range(rng.randrange(1, 16))) for _ in range(400)]

    def plain(t):
        return re.sub(r"(?ms)^([^\n]*)$(?:\n\1$){2,}", lambda m: f"{m[1]} (×{m[0].count(chr(10)) + 1})", t)

    assert column(spark, values, collapse_runs) == [plain(t) for t in values]


def test_only_texts_of_results(spark):
    three = "a\na\na"
    cases = {"s": [user(three), result("1", three, image(three), three), {"role": "assistant", "content": [{"type": "text", "text": three}]}]}
    out = apply(spark, cases, runlength)["s"]
    assert out[0] == cases["s"][0] and out[2] == cases["s"][2]
    assert out[1]["content"] == [{"type": "text", "text": "a (×3)"}, image(three), {"type": "text", "text": "a (×3)"}]


def test_trailing_and_blank(spark):
    values = ["a  \nb\t \n c", "  a b  c", "a \r\nb", "a  ", "x\n\n\n\ny", "x\n\ny\n\n\nz", "\n\n\na", "a\n\n\n", "\n\n", "\n", "", "a\n\n\n\n\nb\n\n\n\nc\n\n\n\n", " " * 5000 + "x"]
    assert column(spark, values, strip_trailing) == [re.sub(r"[ \t]+(?=\n|\Z)", "", v) for v in values]

    def plain(t):
        out, lines, i = [], t.split("\n"), 0
        while i < len(lines):
            j = i
            while j < len(lines) and lines[j] == "":
                j += 1
            out += [""] * (1 if j - i >= 3 else j - i) if j > i else [lines[i]]
            i = max(j, i + 1)
        return "\n".join(out)

    rng = random.Random(2)
    values += ["".join(rng.choice("\n\n\na") for _ in range(rng.randrange(14))) for _ in range(300)]
    assert column(spark, values, collapse_blank) == [plain(v) for v in values]


def test_minify(spark):
    pretty = json.dumps({"a": [1, 2, {"b": None}], "c": "é"}, indent=2, ensure_ascii=False)
    values = [
        "line  \nnext", "  lead", pretty, json.dumps([1, 2], indent=2), '{"a": 1', f"see: {pretty}", "plain", "{}", '{"a":1}', '{"b": 1, "2": 1, "1": 2, "b": 3}',
        '{"n": 12345678901234567890, "x": 1.0, "e": 1e21, "s": 1e-7, "z": -0}', "﻿ [1, 2]  ", '{"a": NaN}', "[1, 2]]", '{"s": "\\u0041\\u001f\\ud83d\\ude00"  }', "[" * 3000,
    ]
    cases = {"s": [user(pretty), *[result(str(i), v) for i, v in enumerate(values)]]}
    out = apply(spark, cases, minify)["s"]
    assert out[0] == cases["s"][0]
    assert [texts(m)[0] for m in out[1:]] == [
        "line\nnext", "  lead", '{"a":[1,2,{"b":null}],"c":"é"}', "[1,2]", '{"a": 1', f"see: {pretty}", "plain", "{}", '{"a":1}', '{"1":2,"2":1,"b":3}',
        '{"n":12345678901234567000,"x":1,"e":1e+21,"s":1e-7,"z":0}', "[1,2]", '{"a": NaN}', "[1, 2]]", '{"s":"A\\u001f😀"}', "[" * 3000,
    ]


#: Numbers and how JavaScript prints them.
NUMBERS = {0.1: "0.1", 1e21: "1e+21", 123456789012345680000.0: "123456789012345680000", 1e-6: "0.000001", 1e-7: "1e-7", 1.5e300: "1.5e+300", -2.5: "-2.5", 100.0: "100", 5e-324: "5e-324", 0.00012: "0.00012", float("inf"): "null"}


@pytest.mark.parametrize("x", NUMBERS)
def test_numbers(x):
    assert jsjson.number(x) == NUMBERS[x]


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12))
def test_json_round_trips(v):
    out = jsjson.stringify(v)
    assert jsjson.parse(out) == (v if not isinstance(v, bool) else v) and jsjson.stringify(jsjson.parse(out)) == out


def test_lengths_and_trimming(spark):
    values = ["", "aé😀\n\"\\", "\x00\x1f\x7f\t", " ﻿ x y  \n", "\x1cx\x85"]
    assert column(spark, values, utf16_len) == [len(v.encode("utf-16-le")) // 2 for v in values]
    assert column(spark, values, json_string_len) == [len(jsjson.string(v).encode()) - 2 for v in values]
    assert column(spark, values, js_trim) == [v.strip(jsjson.SPACE) for v in values]
