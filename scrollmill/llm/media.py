"""Media columns: AVI files of motion-JPEG frames.

Frames are lossless JPEG (spec's SOF3, one 8-bit grey component, predictor 1) so that what is stored is read back to the
bit. Reading parses the RIFF chunks and the idx1 index, decodes each frame by itself, and finds shots where the
histograms of two frames differ by more than the differences around them lead one to expect. Many frames are coded at
once, a sample of each at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scrollmill.llm.common import freeing, small_batches

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
#: Frames that are coded together; bounds the memory that a long text takes.
AT_ONCE = 4096
#: Code lengths of the difference categories 0 to 8, of which canonical Huffman codes are made.
CODE_LENGTHS = {0: 5, 1: 5, 2: 4, 3: 4, 4: 4, 5: 3, 6: 2, 7: 2, 8: 5}
LONGEST_CODE = 16


def _codes() -> dict[int, tuple[int, int]]:
    """{category: (code, length)}, canonical: by length, then category."""
    code, last, out = 0, 0, {}
    for cat, length in sorted(CODE_LENGTHS.items(), key=lambda x: (x[1], x[0])):
        code <<= length - last
        out[cat], last = (code, length), length
        code += 1
    return out


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits and their number by difference + 255; difference and bits used by the next LONGEST_CODE bits."""
    bits, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    diff, used = np.zeros(1 << LONGEST_CODE, np.int16), np.zeros(1 << LONGEST_CODE, np.int64)
    codes = _codes()
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, length = codes[cat]
        low = d if d >= 0 else d + (1 << cat) - 1
        bits[d + 255], size[d + 255] = code << cat | low, length + cat
        free = LONGEST_CODE - length - cat
        at = int(bits[d + 255]) << free
        diff[at : at + (1 << free)], used[at : at + (1 << free)] = d, length + cat
    return bits, size, diff, used


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_head() -> bytes:
    """What stands before the coded samples of a frame."""
    order = sorted(CODE_LENGTHS, key=lambda c: (CODE_LENGTHS[c], c))
    per_length = bytes(sum(1 for c in order if CODE_LENGTHS[c] == n) for n in range(1, 17))
    return (
        b"\xff\xd8"
        + _segment(0xC4, b"\x00" + per_length + bytes(order))
        + _segment(0xC3, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00")
        + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")
    )


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """The JPEG of each frame; samples: (frames, FRAME) of 8 bits."""
    n = len(samples)
    if n > AT_ONCE:
        return [f for at in range(0, n, AT_ONCE) for f in encode_frames(samples[at : at + AT_ONCE])]
    bits, size, _, _ = _tables()
    x = samples.reshape(n, SIDE, SIDE).astype(np.int16)
    before = np.empty_like(x)
    before[:, :, 1:] = x[:, :, :-1]
    before[:, 1:, 0] = x[:, :-1, 0]
    before[:, 0, 0] = 128
    d = (x - before).reshape(n, FRAME) + 255
    length = size[d]
    ends = np.cumsum(length, axis=1)
    total = (ends[:, -1] + 7) >> 3
    base = np.concatenate([[0], np.cumsum(total)])
    at = ((ends - length) + (base[:-1] * 8)[:, None]).ravel()
    length, value = length.ravel(), bits[d].ravel().astype(np.int64)
    value <<= 24 - (at & 7) - length
    out = np.zeros(base[-1] + 3, np.int64)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount((at >> 3) + k, (value >> shift) & 255, len(out)).astype(np.int64)
    pad = (base[1:] * 8 - (ends[:, -1] + base[:-1] * 8)).astype(np.int64)
    out[base[1:] - 1] |= (1 << pad) - 1  # a segment is filled up with ones
    coded, head = out.astype(np.uint8).tobytes(), jpeg_head()
    return [head + coded[a:b].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def entropy_part(jpeg: bytes) -> bytes:
    """The coded samples of a frame, after a check that it is of the kind that is read here."""
    if jpeg[:2] != b"\xff\xd8" or jpeg[-2:] != b"\xff\xd9":
        raise ValueError("not a JPEG frame")
    at = 2
    while True:
        mark, marker, length = struct.unpack_from(">BBH", jpeg, at)
        if mark != 0xFF:
            raise ValueError("a JPEG marker is missing")
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC3 and struct.unpack_from(">BHHB", body) != (8, SIDE, SIDE, 1):
            raise ValueError("frames are 24 by 24 samples of 8 bits")
        if marker == 0xDA:
            return jpeg[at:-2].replace(b"\xff\x00", b"\xff")


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """Samples (frames, FRAME) of frames that encode_frames or any coder with these tables has made."""
    if len(jpegs) > AT_ONCE:
        return np.concatenate([decode_frames(jpegs[at : at + AT_ONCE]) for at in range(0, len(jpegs), AT_ONCE)])
    _, _, diff, used = _tables()
    head = jpeg_head()
    parts = [j[len(head) : -2].replace(b"\xff\x00", b"\xff") if j.startswith(head) else entropy_part(j) for j in jpegs]
    raw = np.frombuffer(b"".join(parts) + bytes(4), np.uint8).astype(np.uint32)
    word = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64) * 8
    d = np.empty((FRAME, len(parts)), np.int16)
    for k in range(FRAME):
        top = (word[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - LONGEST_CODE)
        d[k] = diff[top]
        at += used[top]
    d = d.T.reshape(-1, SIDE, SIDE)
    first = np.cumsum(d[:, :, 0], axis=1, dtype=np.int64) + 128
    rows = np.cumsum(d[:, :, 1:], axis=2, dtype=np.int64) + first[:, :, None]
    return np.concatenate([first[:, :, None], rows], axis=2).astype(np.uint8).reshape(len(parts), FRAME)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """An AVI file of coded frames, with an index."""
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    head = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form))
    body, index, at = [b"movi"], [], 4
    for f in frames:
        body.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", head) + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The coded frames that the index lists, and frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, index, todo = float(FPS), -1, b"", [(12, len(data))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movi = at + 8
            elif name == b"LIST":
                todo.append((at + 12, at + 8 + size))
            elif name == b"avih":
                rate = 1e6 / max(1, struct.unpack_from("<I", data, at + 8)[0])
            elif name == b"idx1":
                index = data[at + 8 : at + 8 + size]
            at += 8 + size + (size & 1)
    if movi < 0:
        raise ValueError("no movi list")
    return [data[movi + at + 8 : movi + at + 8 + n] for name, _, at, n in struct.iter_unpack("<4sIII", index) if name == b"00dc"], rate


def shots(samples: np.ndarray, around: int = 8, factor: int = 3) -> list[tuple[int, int]]:
    """[(first frame, end)] of each shot.

    A cut is where the histograms (16 bins) of two neighbours differ by more than `factor` times the mean difference of
    up to `around` steps on either side, and by an eighth of the samples at least. Whole numbers throughout.
    """
    n = len(samples)
    bins = np.bincount((np.arange(n)[:, None] * 16 + (samples >> 4)).ravel(), minlength=16 * n).reshape(n, 16)
    step = np.abs(np.diff(bins, axis=0)).sum(axis=1)
    total = np.concatenate([[0], np.cumsum(step)])
    i = np.arange(len(step))
    lo, hi = np.maximum(i - around, 0), np.minimum(i + around + 1, len(step))
    others, others_n = total[hi] - total[lo] - step, hi - lo - 1
    cut = (step * others_n > factor * others) & (step >= FRAME // 8)
    edges = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


def store(payload: bytes) -> bytes:
    """The AVI file of a payload whose length is a positive multiple of FRAME."""
    return write_avi(encode_frames(np.frombuffer(payload, np.uint8).reshape(-1, FRAME)))


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text (null: none), filled up with bytes 255 to a positive multiple of FRAME, and its own length."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME), len(raw)


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each whole text as an AVI file. A null text is stored as an empty one: one white frame."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                rows = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in rows], pa.int64()), pa.array([store(p) for p, _ in rows], pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(freeing(run), f"id {kind}, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """(id, clip, start_s, end_s, n_frames): the shots of each file of a table (id, media); a null file has none."""
    small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data = batch.column(1)[i].as_py()
                if data is None:
                    continue
                jpegs, rate = read_avi(data)
                found = shots(decode_frames(jpegs))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * len(found))), *(pa.array(c) for c in zip(*((k, a / rate, b / rate, b - a) for k, (a, b) in enumerate(found)), strict=True))],
                    ["id", "clip", "start_s", "end_s", "n_frames"],
                )

    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "media").mapInArrow(freeing(run), f"id {kind}, clip long, start_s double, end_s double, n_frames long")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: the text stored as an AVI file, read back, and described.

    feature: frames, shots, and a checksum of the shots' bounds. Equal texts give equal rows but for the id; a null text
    counts as empty. Other columns are not read. No rows: no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for lo, hi in _parts(batch.column(1)):
                rows = [padded(t) for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                coded = encode_frames(np.frombuffer(b"".join(p for p, _ in rows), np.uint8).reshape(-1, FRAME))
                files, at = [], 0
                for p, _ in rows:
                    files.append(write_avi(coded[at : at + len(p) // FRAME]))
                    at += len(p) // FRAME
                read = [read_avi(f)[0] for f in files]
                samples = decode_frames([j for js in read for j in js])
                out, at = [], 0
                for f, js, (_, n) in zip(files, read, rows, strict=True):
                    own = samples[at : at + len(js)]
                    at += len(js)
                    back, found = own.tobytes(), shots(own)
                    bounds = zlib.crc32(",".join(f"{a}-{b}" for a, b in found).encode())
                    out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(f), hashlib.sha256(f).hexdigest(), f"frames={len(js)};shots={len(found)};bounds={bounds:08x}"))
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *cols], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(freeing(run), f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    from scrollmill.llm.shingles import slices

    return slices(texts, 1_000_000)


def op6_media(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
