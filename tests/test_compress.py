import json

import pytest
from helpers import apply, call, image, result, texts, transcript, user
from pyspark.sql import functions as F

from scrollmill.functions import jsjson
from scrollmill.operators.runs import map_text
from scrollmill.plans.compress import MINIFY, compress, messages_of, with_stats
from scrollmill.plans.integrity import check_integrity
from scrollmill.plans.report import NO_RUN, grand_total, pass_totals, session_rows, stats_report, timed
from scrollmill.schema import LIVE, Options
from scrollmill.sources.sessions import from_json_messages

LISTING = "\n".join(f"file-{i}.ts  {1000 + i} bytes" for i in range(60))
NAMES = ["pass-a-dedupe", "pass-b-superseded-reads", "pass-c-runlength", "pass-d-block-dedup", "pass-g-shingle-dedup", "pass-e-near-dupe"]


def mixed():
    page = "lorem ipsum dolor sit amet " * 30
    return [
        user("please look"), call("c1", code="open('/a.txt').read()"), result("c1", page), call("c2", "edit", path="/a.txt", edits=[]), result("c2", "ok"), call("c3", code="open('/a.txt').read()"), result("c3", page + "!"),
        call("c4", code="run()"), result("c4", "warn\n" * 40 + "done"), call("c5", code="ls()"), result("c5", LISTING), call("c6", code="ls()"), result("c6", LISTING.replace("file-30", "FILE-30")),
        call("c7", code="shot()"), result("c7", "before", image("A" * 400)), call("c8", code="shot()"), result("c8", "after \"x\"\t\x01", image("A" * 400)), call("c9", code="ls()"), result("c9", LISTING), user("thanks"),
    ]


@pytest.fixture(scope="module")
def ran(spark):
    cases = {"mixed": mixed(), "quiet": [user("hi"), {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hello"}]}, {"role": "note"}, {"role": "assistant", "content": "plain"}]}
    t = transcript(spark, cases)
    out, stats = with_stats(t)
    rows = {(r["session_id"], r["msg_idx"]): r for r in messages_of(out, t).collect()}
    return cases, t, stats, {name: [json.loads(rows[name, i]["raw_json"]) for i in range(len(m))] for name, m in cases.items()}


def js_bytes(messages):
    return len(jsjson.stringify(messages).encode())


def test_a_mixed_session_shrinks_and_sizes_are_those_of_its_json(spark, ran):
    cases, t, stats, out = ran
    assert out["quiet"] == cases["quiet"]
    rows = sorted((r["session_id"], r["pass_no"], r["pass"], r["bytes_before"], r["bytes_after"], r["hits"]) for r in stats.collect())
    for name in cases:
        own = [r for r in rows if r[0] == name]
        assert [r[2] for r in own] == NAMES
        assert own[0][3] == js_bytes(cases[name]) and own[-1][4] == js_bytes(out[name])
        assert all(a[4] == b[3] for a, b in zip(own, own[1:]))
    assert own[-1][4] == own[0][3] and all(r[5] == 0 for r in own)
    grown = [r for r in rows if r[0] == "mixed"]
    assert grown[-1][4] < 0.6 * grown[0][3]
    assert sum(r[5] > 0 for r in grown) >= 5


def test_roles_number_and_pairs_stay(spark, ran):
    cases, t, _, _ = ran
    assert [m["role"] for m in apply(spark, cases, compress)["mixed"]] == [m["role"] for m in cases["mixed"]]
    assert check_integrity(t.messages, messages_of(compress(t), t)).collect() == []


def test_extra_passes_run_last_in_order(spark):
    extra = [("x1", lambda t: map_text(t, lambda s: F.concat(s, F.lit("1")))), ("x2", lambda t: map_text(t, lambda s: F.concat(s, F.lit("2")))), MINIFY]
    cases = {"s": [result("a", "t")], "empty": []}
    t = transcript(spark, cases)
    out, stats = with_stats(t, extra=extra)
    assert [r["pass"] for r in stats.orderBy("pass_no").collect()] == [*NAMES, "x1", "x2", "pass-f-minify"]
    assert texts(apply(spark, {"s": cases["s"]}, lambda x: compress(x, extra=extra))["s"][0]) == ["t12"]


def test_no_messages(spark):
    t = from_json_messages(spark.createDataFrame([], "session_id string, msg_idx int, raw_json string"))
    out, stats = with_stats(t)
    assert messages_of(out, t).count() == 0 and stats.count() == 0


def test_presets_and_references(spark):
    cases = {"s": mixed()}
    live = apply(spark, cases, lambda t: compress(t, LIVE))["s"]
    assert live[12] != cases["s"][12] and live[14] == cases["s"][14]
    same = "the same text, long enough to be found again"
    circle = [call("1", code="open('/a')"), result("1", same), call("2", "edit", path="/a"), result("2", "ok"), call("3", code="open('/a')"), result("3", same)]
    assert apply(spark, {"s": circle}, lambda t: compress(t, Options(safe_refs=True)))["s"][1] == circle[1]


def test_reports(spark, ran):
    cases, t, stats, out = ran
    text = stats_report(stats, "mixed").split("\n")
    before, after = js_bytes(cases["mixed"]), js_bytes(out["mixed"])
    assert text[0] == f"Context compression: {before} -> {after} bytes (-{(1 - after / before) * 100:.2f}%)"
    assert len(text) == 7 and text[1].startswith(f"  pass-a-dedupe: {before} -> ") and text[1].endswith("message(s) touched)")
    assert stats_report(stats, "unknown") == stats_report(None, "mixed") == NO_RUN
    issues = check_integrity(t.messages, t.messages)
    rows = {r["session_id"]: r for r in session_rows(stats, t.messages, issues).collect()}
    assert rows["mixed"]["ok"] and rows["mixed"]["messages"] == len(cases["mixed"]) and rows["mixed"]["tokens_before"] == int(before / 4 + 0.5)
    totals = pass_totals(stats).orderBy("pass_no").collect()
    assert [r["pass"] for r in totals] == NAMES and totals[0]["bytes_before"] == sum(map(js_bytes, cases.values()))
    total = grand_total(session_rows(stats, t.messages, issues)).first()
    assert total["sessions"] == 2 and total["bytes_after"] == after + js_bytes(out["quiet"])
    assert timed({"nothing": lambda: None}, 0)[0]["ms_per_kb"] == 0


def test_integrity_rules(spark):
    def table(messages):
        return transcript(spark, messages).messages

    def rules(before, after):
        return sorted((r["session_id"], r["rule"]) for r in check_integrity(table(before), table(after)).collect())

    good = [call("1", code="x"), result("1", "y"), user("z")]
    assert rules({"s": good}, {"s": good}) == []
    assert rules({"s": good}, {"s": good[:2]}) == [("s", "message_count"), ("s", "role_sequence")]
    assert rules({"s": good}, {"s": [good[1], good[0], good[2]]}) == [("s", "role_sequence")]
    assert rules({"s": good}, {"s": [good[0], user("y"), good[2]]}) == [("s", "result_lost"), ("s", "role_sequence")]
    assert rules({"s": good}, {"s": [call("2", code="x"), *good[1:]]}) == [("s", "call_new"), ("s", "result_orphan")]
    assert rules({"s": good}, {"s": [call("", code="x"), *good[1:]]}) == [("s", "call_count"), ("s", "result_orphan")]
    orphan = [result("9", "y")]
    assert rules({"s": orphan}, {"s": orphan}) == [("s", "result_orphan")]
    assert rules({"s": [call("1", code="x")]}, {"s": [call("1", code="x")]}) == []
    broken = table({"s": [user("a")]}).withColumn("raw_json", F.lit("{"))
    assert [r["rule"] for r in check_integrity(table({"s": [user("a")]}), broken).collect()] == ["json"]
