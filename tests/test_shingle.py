import random
import time

import pandas as pd
import pytest
from helpers import apply, image, result, texts, user

from scrollmill.operators.exact import block_dedupe
from scrollmill.operators.shingle import BASE, MOD, Session, _scan, shingle_dedupe, shingle_texts, units, window_hashes
from scrollmill.queries import repeated_shingles_all
from scrollmill.schema import ShingleOptions

BANNER = "=== build 4711 on host alpha, compiler 12.3, flags -O2 -g, target x86_64, started by the nightly job, see the log for more ==="


def expand(new, said, spans):
    """The text again, from what each marker replaced."""
    at, out, rest = 0, "", new
    for start, n, source in spans:
        head, rest = rest[: start - at], rest[start - at :]
        out += head
        rest = rest[rest.index("]") + 1 :]
        for k in range(n):  # a match may overlap itself
            out += (said + out)[source + k]
        at = start + n
    return out + rest


def plain(texts, size, least):
    """The same scan, one place at a time."""
    said, first, out = "", {}, []
    for ref, text in texts:
        base, res, i, copied = len(said), "", 0, 0
        said += text
        while i + size <= len(text):
            h = 0
            for c in text[i : i + size]:
                h = (h * BASE + ord(c)) % MOD
            if h in first:
                at, who = first[h]
                n = 0
                while i + n < len(text) and said[at + n] == text[i + n]:
                    n += 1
                marker = f"[repeated substring, {len(text[i : i + n].encode())} bytes, see earlier occurrence in toolCallId {who}]"
                if n >= max(size, least) and len(marker) < n:
                    res, i = res + text[copied:i] + marker, i + n
                    copied = i
                    continue
            else:
                first[h] = (base + i, ref)
            i += 1
        out.append(res + text[copied:])
    return out


@pytest.mark.parametrize(("size", "least"), [(8, 8), (64, 64), (16, 100)])
def test_agrees_with_a_plain_scan_and_can_be_expanded(size, least):
    rng = random.Random(size)
    parts = ["".join(rng.choice("ab é") for _ in range(rng.choice([30, 90, 200]))) for _ in range(5)]
    texts = [(f"c{i}", "".join(rng.choice([*parts, "xyz", "-"]) for _ in range(rng.randrange(6)))) for i in range(40)]
    session, said, got = Session(ShingleOptions(size, least)), "", []
    for ref, text in texts:
        new, spans = session.take(text, ref)
        assert expand(new, said, spans) == text
        said += text
        got.append(new)
    assert got == plain(texts, size, least)


def test_window_hashes():
    codes = units("héllo wörld 😀 again")
    want = [sum(int(c) * pow(BASE, 4 - k, MOD) for k, c in enumerate(codes[i : i + 5])) % MOD for i in range(len(codes) - 4)]
    assert window_hashes(codes, 5).tolist() == want and len(window_hashes(codes[:3], 5)) == 0


def test_shingles(spark):
    big = BANNER * 10
    short = "a short shared line"
    cases = {
        "across": [result("c1", f"one\n{BANNER}\nfirst tail"), user(BANNER), result("c2", f"two\n{BANNER}\nsecond tail")],
        "within": [result("c1", f"{BANNER} middle {BANNER}")],
        "plain": [result("c1", "nothing here"), result("c2", "nor there")],
        "short": [result("c1", short), result("c2", short)],
        "image": [result("c1", BANNER, image("A" * 99)), result("c2", BANNER, image("A" * 99))],
        "none": [user(BANNER), user(BANNER)],
        "borders": [result("c1", BANNER[:70]), result("c2", BANNER[70:]), result("c3", BANNER)],
        "recent": [result(f"c{i}", f"{i} {big}") for i in range(4)],
        "recent mixed": [result("c0", f"0 {big}"), result("c1", f"1 {big}"), user("u"), user("v")],
    }
    out = apply(spark, cases, shingle_dedupe)
    marker = f"[repeated substring, {len(BANNER) + 2} bytes, see earlier occurrence in toolCallId c1]"
    assert out["across"][0] == cases["across"][0] and texts(out["across"][2]) == [f"two{marker}second tail"]
    assert texts(out["within"][0]) == [f"{BANNER} middle [repeated substring, {len(BANNER)} bytes, see earlier occurrence in toolCallId c1]"]
    for name in ("plain", "short", "none"):
        assert out[name] == cases[name]
    assert out["image"][1]["content"] == [{"type": "text", "text": f"[repeated substring, {len(BANNER)} bytes, see earlier occurrence in toolCallId c1]"}, image("A" * 99)]
    assert texts(out["borders"][2]) == [f"[repeated substring, {len(BANNER)} bytes, see earlier occurrence in toolCallId c1]"]
    keep = ShingleOptions(min_repeat=1024, recent_window=2)
    out = apply(spark, cases, lambda t: shingle_dedupe(t, keep))
    assert out["across"] == cases["across"] and out["recent"][2:] == cases["recent"][2:]
    assert "repeated substring" in texts(out["recent"][1])[0]
    assert "repeated substring" in texts(out["recent mixed"][1])[0]  # the window counts messages of any role


def test_endless_repetition_and_long_texts():
    start = time.perf_counter()
    new, spans = Session(ShingleOptions()).take("abcdefghij" * 5000, "c1")
    assert len(new) < 1000 and len(spans) == 1 and time.perf_counter() - start < 1
    session = Session(ShingleOptions())
    outs = [session.take("abc " * 500, f"c{i}")[0] for i in range(50)]
    assert all(len(o) < 300 for o in outs[1:])
    took = []
    for n in (1 << 16, 1 << 20):
        rng = random.Random(1)
        text = "".join(rng.choice("abcdefghijklmnop") for _ in range(n // 2))
        start = time.perf_counter()
        new, _ = Session(ShingleOptions()).take(text + text, "c")
        took.append(time.perf_counter() - start)
        assert new.startswith(text) and len(new) < n // 2 + 100
    assert took[1] < 60 * took[0]


def test_characters_are_never_parted(spark):
    rng = random.Random(9)
    pool = ["😀", "🎉", "中文", "é", "plain words "]
    shared = "".join(rng.choice(pool) for _ in range(80))
    cases = {f"s{i}": [result("c1", "x" * i + shared + "😀end"), result("c2", "y😁" + shared + "😂tail")] for i in range(8)}
    # Halves that match while the characters differ: U+1F600 and U+1F601 share the first half, U+1F600 and U+1FA00 the second.
    cases["halves"] = [result("c1", "\U0001f600" + "m" * 100 + "\U0001f600"), result("c2", "\U0001fa00" + "m" * 100 + "\U0001f601")]
    for m in apply(spark, cases, shingle_dedupe)["halves"]:
        texts(m)[0].encode()
    new, spans = Session(ShingleOptions()), None
    new.take(cases["halves"][0]["content"][0]["text"], "c1")
    out, spans = new.take(cases["halves"][1]["content"][0]["text"], "c2")
    assert out == "\U0001fa00[repeated substring, 100 bytes, see earlier occurrence in toolCallId c1]\U0001f601" and spans[0][1] == 100


def test_markers_count_bytes():
    session = Session(ShingleOptions())
    session.take("é" * 10 + "中" * 100, "c1")
    assert "[repeated substring, 300 bytes" in session.take("z" + "中" * 100, "c2")[0]


def test_after_block_dedupe(spark):
    text = f"{BANNER}\n{BANNER}\n" * 2
    cases = {"s": [result("c1", text), result("c2", "other", text)]}
    out = apply(spark, cases, lambda t: shingle_dedupe(block_dedupe(t)))["s"]
    assert texts(out[1])[1].count("[identical text block") == 1 and "repeated" not in texts(out[1])[1]


def test_repeats_at_any_place_are_found(spark, tmp_path):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefé😀 ") for _ in range(70))
    docs = [(k, "en" if k % 3 else "de", "".join(rng.choice("xyz ") for _ in range(rng.randrange(90))) + passage * (1 + (k == 4)) + "tail"[: k % 5]) for k in range(12)]
    docs += [(20, "en", "x" * 66), (21, "en", "short"), (22, "en", ""), (23, "fr", passage)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    at = {}
    for i, lang, text in docs:
        for k in range(len(text) - 63):
            at.setdefault((lang, text[k : k + 64]), []).append((i, k))
    want = sorted((*key, len(p), *min(p)) for key, p in at.items() if len(p) > 1)
    got = sorted(map(tuple, repeated_shingles_all(spark, str(tmp_path)).collect()))
    assert got == want and {lang for lang, *_ in got} == {"en", "de"}


def test_a_collision_hides_no_match():
    """"b`" and "aš" have one hash in the place of two units, whatever is around."""
    one, other = BANNER[:31] + "b`" + BANNER[31:62], BANNER[:31] + "aš" + BANNER[31:62]
    codes = [window_hashes(units(x[:64]), 64).tolist() for x in (one + "-", other + "-")]
    assert codes[0] == codes[1]
    tail = "".join(chr(200 + k) for k in range(100))
    session = Session(ShingleOptions())
    session.take(f"{one}-", "c1")
    session.take(f"{other}-{tail}", "c2")
    assert session.take(f"x{other}-{tail}y", "c3") == (f"x[repeated substring, {len(f'{other}-{tail}'.encode())} bytes, see earlier occurrence in toolCallId c2]y", [(1, 165, 65)])


ROWS = "session_id string, msg_idx int, block_idx int, text string, ref string, protected boolean"


def _made(seed, alphabet, wide):
    """Texts of sessions that copy parts of each other, short and empty ones, over borders too, repetitions, and some protected."""
    rng = random.Random(seed)
    rows = []
    for s in range(6):
        said = ""
        for k in range(45):
            parts = []
            for _ in range(rng.randrange(5)):
                kind = rng.randrange(6)
                if kind < 3 and said:
                    a = rng.randrange(len(said))
                    parts.append(said[a : a + rng.choice([5, 20, 63, 64, 70, 80, 90, 200, 700])])
                elif kind == 3:
                    parts.append("".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 7]))) * rng.choice([3, 40]))
                else:
                    parts.append("".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 10, 64, 150]))))
            text = "".join(parts)
            said += text
            rows.append((f"s{s}", k - 20, k % 3, text, f"r{'é😀' * wide * (k % 2)}-{k}", rng.random() < 0.1))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "least", "alphabet"), [(64, 64, "ab é中😀🎉"), (8, 30, "aé😀"), (64, 150, "abcdefgh"), (1, 1, "ab中"), (7, 80, "ab")])
def test_long_sessions_by_parts(spark, size, least, alphabet):
    """F2 to F6, F9, F10: a session that no task holds gives what a scan of the whole gives."""
    options, rows = ShingleOptions(size, least), _made(size + least, alphabet, len(alphabet) % 2)
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])
    want = sorted((*r[:4], [tuple(x.values()) for x in r[4]]) for _, of in frame.groupby("session_id") for r in _scan(of, options))
    got = shingle_texts(spark.createDataFrame(rows, ROWS), options, most=0)
    assert len(want) > 4 and sorted((*r[:4], [tuple(x) for x in r["spans"]]) for r in got.collect()) == want
