import json
import os

import pytest
from helpers import call, image, result, user
from pyspark.errors import AnalysisException

from scrollmill import cli
from scrollmill.plans.compress import messages_of
from scrollmill.sources.sessions import from_json_messages, read_sessions
from scrollmill.streaming.recompute import LINES, stream_sessions


def entry(message, **more):
    return json.dumps({"type": "message", "id": "x", "parentId": None, "message": message, **more}, ensure_ascii=False)


@pytest.fixture
def folder(tmp_path):
    page = "text of a page, long enough to count\n" * 4
    lines = [entry(user("hi")), "", "{broken", "null", '{"type":"message","message":null}', '{"type":"note","message":{"role":"user"}}', entry(call("c1", code="ls()", n=3)), entry(result("c1", page, image("QUJD")))]
    (tmp_path / "one.jsonl").write_text("\n\n" + "\n".join(lines) + "\n \n", encoding="utf-8")
    (tmp_path / "two.jsonl").write_text("\n".join([entry({"role": "user", "content": '["not an array"]'}), entry(call("a", code="x")), entry(result("a", page)), entry(call("b", code="x")), entry(result("b", page))]))
    (tmp_path / "skip.txt").write_text("no")
    return tmp_path


def test_sessions_from_files(spark, folder):
    t = read_sessions(spark, str(folder))
    got = [(r["session_id"], r["msg_idx"], r["role"], r["tool_call_id"], r["content_is_array"]) for r in t.messages.orderBy("session_id", "msg_idx").collect()]
    assert got == [
        ("one", 0, "user", None, False), ("one", 1, "assistant", None, True), ("one", 2, "toolResult", "c1", True),
        ("two", 0, "user", None, False), ("two", 1, "assistant", None, True), ("two", 2, "toolResult", "a", True), ("two", 3, "assistant", None, True), ("two", 4, "toolResult", "b", True),
    ]
    assert [(r["block_type"], r["mime_type"], r["data"]) for r in t.blocks.where("session_id = 'one'").orderBy("block_idx").collect()] == [("text", None, None), ("image", "image/png", "QUJD")]
    args = [(r["session_id"], r["arg_idx"], r["arg_key"], r["arg_value"]) for r in t.call_args.orderBy("session_id", "msg_idx").collect()]
    assert args == [("one", 0, "code", "ls()"), ("two", 0, "code", "x"), ("two", 0, "code", "x")]
    assert messages_of(t, t).collect() and json.loads(t.messages.where("session_id = 'two' and msg_idx = 0").first()["raw_json"])["content"] == '["not an array"]'


def test_command_line(spark, folder, tmp_path_factory, capsys):
    assert cli.main(str(folder), spark) == 0
    out = capsys.readouterr().out
    assert "all sessions passed" in out and "one: 3 messages" in out and "two: 5 messages" in out
    assert all(x in out for x in ("with pass-f-minify", "min_ms", "avg_ms", "ms/KB"))
    (folder / "bad.jsonl").write_text(entry(result("nobody", "y")))
    assert cli.main(str(folder), spark) == 1
    assert "bad: Tool result without a call: nobody" in capsys.readouterr().out
    assert cli.main(str(tmp_path_factory.mktemp("none")), spark) == 0
    assert cli.main(str(folder / "missing"), spark) == 1
    with pytest.raises(AnalysisException):
        read_sessions(spark, str(folder / "missing"))


def test_stream_replaces_the_sessions_that_grow(spark, tmp_path):
    page = "a page that is long enough, "
    source, latest = tmp_path / "in", {}
    os.makedirs(source)

    def emit(messages, number):
        rows = messages.orderBy("session_id", "msg_idx").collect()
        for name in {r["session_id"] for r in rows}:
            latest[name] = [json.loads(r["raw_json"]) for r in rows if r["session_id"] == name]

    def push(n, rows):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"session_id": s, "line_no": k, "line": entry(m)}) for s, k, m in rows))
        stream = spark.readStream.schema(LINES).json(str(source))
        stream_sessions(stream, str(tmp_path / "log"), emit, str(tmp_path / "state")).awaitTermination()

    read = lambda i: [call(i, code="open('/a').read()"), result(i, page + i)]
    push(1, [("s", k, m) for k, m in enumerate(read("1"))] + [("t", 0, user("only"))])
    assert latest["s"] == read("1")
    latest.pop("t")
    push(2, [("s", 2 + k, m) for k, m in enumerate([call("2", "edit", path="/a"), result("2", "ok"), *read("3")])])
    assert "stale" in latest["s"][1]["content"][0]["text"] and len(latest["s"]) == 6 and "t" not in latest


def test_arguments_are_put_in_order_within_their_row(spark):
    """their texts were exchanged for it."""
    raw = '{"role":"assistant","content":[{"type":"toolCall","id":"c","name":"n","arguments":{"b":"1","10":"2","9":"3","a":"4","n":5,"4294967295":"6"}}]}'
    args = from_json_messages(spark.createDataFrame([("s", 0, raw)], "session_id string, msg_idx int, raw_json string")).call_args
    assert [(r["arg_idx"], r["arg_key"]) for r in sorted(args.collect(), key=lambda r: r["arg_idx"])] == [(0, "9"), (1, "10"), (2, "b"), (3, "a"), (5, "4294967295")]
    assert "Exchange" not in args._jdf.queryExecution().toString()
