import json

from scrollmill.plans.compress import messages_of
from scrollmill.sources.sessions import from_json_messages


def result(call_id, *blocks, **more):
    content = [{"type": "text", "text": b} if isinstance(b, str) else b for b in blocks]
    return {"role": "toolResult", "toolCallId": call_id, "toolName": "ipython", "content": content, "isError": False, **more}


def image(data, mime="image/png"):
    return {"type": "image", "data": data, "mimeType": mime}


def call(call_id, name="ipython", **arguments):
    return {"role": "assistant", "content": [{"type": "toolCall", "id": call_id, "name": name, "arguments": arguments}]}


def user(text):
    return {"role": "user", "content": text}


def transcript(spark, cases):
    """A transcript with a session for each case, a list of messages."""
    rows = [(name, i, json.dumps(m, ensure_ascii=False, separators=(",", ":"))) for name, messages in cases.items() for i, m in enumerate(messages)]
    return from_json_messages(spark.createDataFrame(rows, "session_id string, msg_idx int, raw_json string"))


def apply(spark, cases, step):
    """The messages of each case after step, which must keep their number and roles and change nothing else than contents."""
    t = transcript(spark, cases)
    out = {name: [None] * len(messages) for name, messages in cases.items()}
    for r in messages_of(step(t), t).collect():
        assert out[r["session_id"]][r["msg_idx"]] is None
        out[r["session_id"]][r["msg_idx"]] = json.loads(r["raw_json"])
    for name, messages in cases.items():
        for old, new in zip(messages, out[name], strict=True):
            assert {k: v for k, v in old.items() if k != "content"} == {k: v for k, v in new.items() if k != "content"}
            if old["role"] not in ("toolResult", "assistant"):
                assert old == new
    return out


def texts(message):
    return [b.get("text") for b in message["content"]]
