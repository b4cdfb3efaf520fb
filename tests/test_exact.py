from helpers import apply, call, image, result, user

from scrollmill.operators.exact import block_dedupe, exact_dedupe
from scrollmill.schema import BlockOptions, ExactOptions

X = "x" * 80


def test_whole_results(spark):
    cases = {
        "twice": [call("a", code="1"), result("a", X), call("b", code="2"), result("b", X, extra={"k": [1, None]})],
        "one letter": [result("a", X), result("b", X[:-1] + "y")],
        "short": [result("a", "ok"), result("b", "ok"), result("c", "é" * 19), result("d", "é" * 19), result("e", "é" * 20), result("f", "é" * 20)],
        "thrice": [result("a", X), result("b", X), result("c", X)],
        "others": [user(X), {"role": "system", "content": X}, result("a", X), {"role": "assistant", "content": [{"type": "text", "text": X}]}],
        "images": [result("a", image("A" * 80)), result("b", image("B" * 80))],
        "same image": [result("a", image("A" * 80)), result("b", image("A" * 80)), result("c", image("A" * 80, "image/gif"))],
        "blocks": [result("a", X, X), result("b", X + "\n\0\ntext:" + X), result("c", X, X, details="kept")],
    }
    out = apply(spark, cases, exact_dedupe)
    marker = "[identical to output of toolCallId a, 80 bytes elided]"
    assert [texts_of(m) for m in out["twice"][1::2]] == [[X], [marker]] and out["twice"][3]["extra"] == {"k": [1, None]}
    assert out["one letter"] == cases["one letter"] and out["others"] == cases["others"] and out["images"] == cases["images"]
    assert out["short"][:5] == cases["short"][:5]
    assert texts_of(out["short"][5]) == ["[identical to output of toolCallId e, 40 bytes elided]"]
    assert [texts_of(m) for m in out["thrice"]] == [[X], [marker], [marker]]
    assert texts_of(out["same image"][1]) == [marker] and out["same image"][2] == cases["same image"][2]
    # A text that spells the border between two blocks counts as those two.
    assert [texts_of(m) for m in out["blocks"][1:]] == [[f"[identical to output of toolCallId a, {n} bytes elided]"] for n in (168, 160)]


def texts_of(message):
    return [b["text"] for b in message["content"]]


def test_sessions_are_apart_and_thresholds_hold(spark):
    cases = {"s1": [result("a", X)], "s2": [result("b", X)], "s3": [result("c", "12345"), result("d", "12345")]}
    assert apply(spark, cases, exact_dedupe) == cases
    out = apply(spark, cases, lambda t: exact_dedupe(t, ExactOptions(min_length=5)))
    assert texts_of(out["s3"][1]) == ["[identical to output of toolCallId c, 5 bytes elided]"]


def test_blocks(spark):
    big, other = image("A" * 300), image("B" * 300)
    odd = {"type": "chart", "points": [1, 2]}
    cases = {
        "sibling": [result("a", "first", big), result("b", "second", big)],
        "differ": [result("a", big), result("b", other)],
        "small": [result("a", "y" * 199), result("b", "y" * 199)],
        "same message": [result("a", "z" * 200, odd, "z" * 200), result("b", odd, odd)],
        "thrice": [result("a", "z" * 200), result("b", "q", "z" * 200), result("c", "z" * 200)],
    }
    out = apply(spark, cases, block_dedupe)
    assert out["sibling"][0] == cases["sibling"][0]
    assert out["sibling"][1]["content"] == [{"type": "text", "text": "second"}, {"type": "text", "text": "[identical image block to output of toolCallId a, 300 bytes elided]"}]
    assert out["differ"] == cases["differ"] and out["small"] == cases["small"]
    marker = "[identical text block to output of toolCallId a, 200 bytes elided]"
    assert out["same message"][0]["content"] == [{"type": "text", "text": "z" * 200}, odd, {"type": "text", "text": marker}]
    assert out["same message"][1] == cases["same message"][1]
    assert texts_of(out["thrice"][1]) == ["q", marker] and texts_of(out["thrice"][2]) == [marker]
    assert texts_of(apply(spark, cases, lambda t: block_dedupe(t, BlockOptions(100)))["small"][1]) == ["[identical text block to output of toolCallId a, 199 bytes elided]"]
