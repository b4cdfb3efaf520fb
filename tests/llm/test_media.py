import hashlib
import zlib

import numpy as np
import pytest

from scrollmill.llm import media as m


@pytest.mark.parametrize("kind", ["noise", "text", "white", "steps", "many"])
def test_frames_come_back_to_the_bit(kind, monkeypatch):
    rng = np.random.default_rng(4)
    x = {
        "noise": rng.integers(0, 256, (20, m.FRAME)),
        "text": np.resize(np.frombuffer(b"lorem ipsum dolor ", np.uint8), (3, m.FRAME)),
        "white": np.full((2, m.FRAME), 255),
        "steps": np.tile([0, 255], (2, m.FRAME // 2)),
        "many": rng.integers(0, 256, (30, m.FRAME)),
    }[kind].astype(np.uint8)
    if kind == "many":
        monkeypatch.setattr(m, "AT_ONCE", 7)
    frames = m.encode_frames(x)
    assert len(frames) == len(x) and (m.decode_frames(frames) == x).all()
    assert all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in frames)
    assert m.entropy_part(frames[0]) == frames[0][len(m.jpeg_head()) : -2].replace(b"\xff\x00", b"\xff")


def test_a_plain_decoder_agrees():
    """Bit by bit, by the standard's rules."""
    x = np.random.default_rng(9).integers(90, 150, (1, m.FRAME)).astype(np.uint8)
    bits = "".join(f"{b:08b}" for b in m.entropy_part(m.encode_frames(x)[0]))
    names = {f"{code:0{length}b}": cat for cat, (code, length) in m._codes().items()}
    at, out = 0, []
    for k in range(m.FRAME):
        end = next(e for e in range(at + 1, at + 17) if bits[at:e] in names)
        cat, at = names[bits[at:end]], end
        v = int(bits[at : at + cat] or "0", 2)
        at += cat
        d = v if not cat or v >> (cat - 1) else v - (1 << cat) + 1
        row, col = divmod(k, m.SIDE)
        out.append((d + (128 if k == 0 else out[-m.SIDE] if col == 0 else out[-1])) & 255)
    assert out == x[0].tolist() and set(bits[at:]) <= {"1"}


def test_index_is_read_and_bad_files_are_refused():
    x = np.random.default_rng(2).integers(0, 256, (5, m.FRAME)).astype(np.uint8)
    data = m.store(x.tobytes())
    frames, rate = m.read_avi(data)
    assert rate == m.FPS and (m.decode_frames(frames) == x).all()
    for bad in (b"", b"RIFF    WAVE", data[:12]):
        with pytest.raises(ValueError):
            m.read_avi(bad)
    with pytest.raises(ValueError):
        m.entropy_part(b"\xff\xd8\x00\x00\x00\x02\xff\xd9")


def test_shots():
    dark, light = np.zeros((20, m.FRAME), np.uint8), np.full((15, m.FRAME), 250, np.uint8)
    assert m.shots(np.concatenate([dark, light, dark])) == [(0, 20), (20, 35), (35, 55)]
    assert m.shots(dark) == [(0, 20)] and m.shots(dark[:1]) == [(0, 1)]


def plain_shots(payload, around=8):
    """Frame by frame, without arrays."""
    frames = [payload[k : k + m.FRAME] for k in range(0, len(payload), m.FRAME)]
    bins = [[sum(1 for b in f if b >> 4 == k) for k in range(16)] for f in frames]
    step = [sum(abs(p - q) for p, q in zip(x, y, strict=True)) for x, y in zip(bins, bins[1:], strict=False)]
    edges = [0]
    for i, s in enumerate(step):
        others = [step[j] for j in range(max(0, i - around), min(len(step), i + around + 1)) if j != i]
        if s * len(others) > 3 * sum(others) and s >= m.FRAME // 8:
            edges.append(i + 1)
    return list(zip(edges, [*edges[1:], len(frames)], strict=True))


def test_feature_of_each_text(spark):
    texts = ["", "a" * 5000, "a" * 9000 + "é" * 4000 + "Z" * 7000, "".join(chr(32 + (k * k) % 90) for k in range(20000)), "0" * 6000 + "~" * 600 + "0" * 6000, None]
    got = {r["id"]: r["feature"] for r in m.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        found = plain_shots(m.padded(t)[0])
        bounds = ",".join(f"{a}-{b}" for a, b in found)
        assert got[i] == f"frames={found[-1][1]};shots={len(found)};bounds={zlib.crc32(bounds.encode()):08x}"
    assert len({plain_shots(m.padded(t)[0])[-1] for t in texts}) > 2


def test_digest_of_each_text(corpus, no_rows):
    docs, rows = corpus
    text = {r[0]: (r[1] or "").encode() for r in rows}
    got = m.digest(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = text[r["id"]]
        whole = raw + b"\xff" * (-len(raw) % m.FRAME if raw else m.FRAME)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(whole))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(whole[-32:])
        assert r["media_sha256"] == hashlib.sha256(m.store(whole)).hexdigest() and r["media_bytes"] == len(m.store(whole))
    by_text = {}
    for r in got:
        assert by_text.setdefault(text[r["id"]], r[1:]) == r[1:]
    assert m.digest(no_rows).count() == 0


def test_clips_of_a_column(corpus, spark):
    docs, rows = corpus
    got = m.clips(m.encode_column(docs)).collect()
    frames = {r[0]: max(1, -(-len((r[1] or "").encode()) // m.FRAME)) for r in rows}
    total = {}
    for r in got:
        total[r["id"]] = total.get(r["id"], 0) + r["n_frames"]
        assert abs((r["end_s"] - r["start_s"]) * m.FPS - r["n_frames"]) < 1e-6
    repeated = rows[-1][0]
    assert all(total[i] == n * (2 if i == repeated else 1) for i, n in frames.items())
    assert m.clips(spark.createDataFrame([(1, None)], "id long, media binary")).count() == 0
