"""Quality scores by co-training.

One classifier sees only what a text says, the other only the page's metadata (source, language, size and layout). In
each round either labels the unlabelled rows it is surest of, and the other learns from them too. In the end the two are
calibrated on labelled rows that neither has seen and combined into one score for every document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollmill.llm.common import cut, freeing, small_batches, unit_hash

#: Hashed words, then bins of shares and lengths.
WORDS, BINS = 1 << 10, 12
TEXT_DIMS = WORDS + 6 * BINS
#: Hashed sources and languages, then bins of sizes.
SOURCES, LANGS, SIZES = 64, 32, 24
META_DIMS = SOURCES + LANGS + 3 * SIZES
#: Labelled rows that training takes at most, on average. Of the unlabelled ones all take part.
LABELLED = 4000
#: Rounds, and from what chance on a view passes a row on. Scans of the unlabelled rows by which the text view is fitted in a round, at most.
ROUNDS, SURE, SCANS = 5, 0.9, 12


def text_features(text: str | None) -> np.ndarray:
    """The text-content view of a document: unit-length word counts (log), and one bin each of shares of characters and words."""
    x = np.zeros(TEXT_DIMS, np.float32)
    words = (text or "").split()
    if not words:
        return x
    n = np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in words], minlength=WORDS)
    x[:WORDS] = np.log1p(n)
    x[:WORDS] /= np.sqrt(x[:WORDS] @ x[:WORDS])
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    shares = (
        ((c >= 65) & (c <= 90)).mean(),
        ((c >= 48) & (c <= 57)).mean(),
        ((c > 32) & (c < 48) | (c > 57) & (c < 65) | (c > 90) & (c < 97) | (c > 122) & (c < 127)).mean(),
        len(set(words)) / len(words),
        min(1.0, len(words) / len(c) * 2),
        max(n) / len(words),
    )
    for k, s in enumerate(shares):
        x[WORDS + k * BINS + min(BINS - 1, int(s * BINS) if k > 2 else int(s * 4 * BINS))] = 1
    return x


def meta_features(source: str | None, lang: str | None, n_chars: int | None, n_lines: int | None) -> np.ndarray:
    """The page-metadata view; what is null has a place of its own."""
    x = np.zeros(META_DIMS, np.float32)
    at = 0
    for value, size in ((source, SOURCES), (lang, LANGS)):
        x[at + (0 if value is None else 1 + zlib.crc32(value.encode()) % (size - 1))] = 1
        at += size
    lines = None if not n_lines or n_chars is None else n_chars / n_lines
    for value in (n_chars, n_lines, lines):
        x[at + (0 if value is None else min(SIZES - 1, 1 + int(2 * math.log2(max(1, value)) / 2)))] = 1
        at += SIZES
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 150, times: np.ndarray | None = None) -> np.ndarray:
    """Weights and bias (last) by accelerated gradient descent; classes weigh the same, and one class alone gives zero weights.

    times: how many rows each row stands for.
    """
    w = np.zeros(x.shape[1] + 1)
    if len(set(y.tolist())) < 2:
        return w
    times = np.ones(len(y)) if times is None else times
    share = times * np.where(y == 1, 0.5 / max(1, times[y == 1].sum()), 0.5 / max(1, times[y == 0].sum()))
    rate, v = 1.0 / (0.25 * (np.square(x).sum(axis=1).max() + 1) + l2), w.copy()
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v[:-1] + v[-1], -30, 30)))
        g = share * (p - y)
        new = v - rate * np.append(x.T @ g + l2 * v[:-1], g.sum())
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def class_sums(z: np.ndarray, y: np.ndarray, back: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with logits z and labels y, by class: how many, their loss, and its gradient; back turns weights of rows into sums of their features."""
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    loss = np.logaddexp(0, np.where(y == 1, -z, z))
    g = [np.where(y == c, p - y, 0.0) for c in (0, 1)]
    return n, np.array([loss[y == c].sum() for c in (0, 1)]), np.stack([np.append(back(d), d.sum()) for d in g])


def fit_sums(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], w: np.ndarray, l2: float = 1e-3, scans: int = SCANS) -> np.ndarray:
    """What fit_logistic minimizes, from sums over all rows, by L-BFGS from w on; both classes must have rows."""

    def value(v: np.ndarray) -> tuple[float, np.ndarray]:
        n, loss, grad = sums(v)
        return float((0.5 * loss / n).sum() + l2 / 2 * v[:-1] @ v[:-1]), (0.5 * grad / n[:, None]).sum(axis=0) + l2 * np.append(v[:-1], 0)

    f, g = value(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1.0
    for _ in range(scans - 1):
        if np.abs(g).max() < 1e-5:
            break
        d, kept = -g, []
        for s, r in reversed(past):
            kept.append(s @ d / (s @ r))
            d = d - kept[-1] * r
        d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1.0)
        for (s, r), a in zip(past, reversed(kept), strict=True):
            d = d + (a - r @ d / (s @ r)) * s
        new = w + step * d
        f_new, g_new = value(new)
        if f_new > f + 1e-4 * step * (g @ d):  # too far
            step /= 2
            continue
        if (new - w) @ (g_new - g) > 1e-12:
            past = [*past, (new - w, g_new - g)][-10:]
        w, f, g, step = new, f_new, g_new, 1.0
    return w


def first_sure(scores: list[np.ndarray], sure: float) -> np.ndarray:
    """The label that each row got in the first round in which the logit was sure; -1: in none."""
    edge, out = math.log(sure / (1 - sure)), np.full(len(scores[0]), -1)
    for s in scores:
        out = np.where(out >= 0, out, np.where(s >= edge, 1, np.where(s <= -edge, 0, -1)))
    return out


@dataclass
class Rows:
    """Unlabelled rows at hand."""

    xt: np.ndarray
    xm: np.ndarray

    def text_sums(self, w: np.ndarray, meta: list[np.ndarray], sure: float):
        """class_sums of the text view with weights w over the rows that the metadata view has been sure of."""
        y = first_sure([logits(self.xm, v) for v in meta], sure)
        x = self.xt[y >= 0].astype(float)
        return class_sums(logits(x, w), y[y >= 0], lambda d: d @ x)

    def meta_rows(self, text: list[np.ndarray], sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Metadata features, labels, and how often each occurs, of the rows that the text view has been sure of."""
        y = first_sure([logits(self.xt, v) for v in text], sure)
        return self.xm[y >= 0], y[y >= 0], np.ones((y >= 0).sum())


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features that are not zero: (row, place, value) of the text view, and five places a row of the metadata view."""
    got = [batch.column(c).to_pylist() for c in ("xi", "xv", "xm")]
    row = np.repeat(np.arange(len(batch)), [len(b) // 2 for b in got[0]])
    at, value = np.frombuffer(b"".join(got[0]), "<u2").astype(np.int64), np.frombuffer(b"".join(got[1]), "<f2").astype(float)
    return row, at, value, np.frombuffer(b"".join(got[2]), np.uint8).reshape(len(batch), -1)


@dataclass
class Table:
    """Unlabelled rows of a table (xi, xv, xm); each call is one scan on the executors, of which sums or counts come back."""

    rows: DataFrame

    def text_sums(self, w: np.ndarray, meta: list[np.ndarray], sure: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(4 + 2 * len(w))
            for batch in batches:
                if not len(batch):
                    continue
                row, at, value, xm = _sparse(batch)
                y = first_sure([v[xm].sum(axis=1) + v[-1] for v in meta], sure)
                use = y[row] >= 0
                row, at, value = row[use], at[use], value[use]
                z = np.bincount(row, value * w[at], len(y)) + w[-1]
                back = lambda d: np.bincount(at, value * full(d)[row], len(w) - 1)  # noqa: E731, B023

                def full(d, y=y):
                    out = np.zeros(len(y))
                    out[y >= 0] = d
                    return out

                total += np.concatenate([x.ravel() for x in class_sums(z[y >= 0], y[y >= 0], back)])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        total = np.sum([np.zeros(4 + 2 * len(w)), *(np.frombuffer(r["sums"]) for r in self.rows.mapInArrow(run, "sums binary").collect())], axis=0)
        return total[:2], total[2:4], total[4:].reshape(2, -1)

    def meta_rows(self, text: list[np.ndarray], sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                row, at, value, _ = _sparse(batch)
                y = first_sure([np.bincount(row, value * w[at], len(batch)) + w[-1] for w in text], sure)
                yield pa.RecordBatch.from_arrays([batch.column("xm"), pa.array(y, pa.int32())], ["xm", "y"])

        got = self.rows.mapInArrow(run, "xm binary, y int").where("y >= 0").groupBy("xm", "y").count().collect()
        got.sort(key=lambda r: (bytes(r["xm"]), r["y"]))
        x = np.zeros((len(got), META_DIMS), np.float32)
        for k, r in enumerate(got):
            x[k, np.frombuffer(r["xm"], np.uint8)] = 1
        return x, np.array([r["y"] for r in got], int), np.array([r["count"] for r in got], float)


def fit_platt(s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(slope, offset) that turn a logit into that of the chance of class 1."""
    a = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a[0] * s + a[1], -30, 30)))
        d, h = p - y, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * s).sum() + 1e-2 * (a[0] - 1), d.sum() + 1e-2 * a[1]])
        m = np.array([[(h * s * s).sum() + 1e-2, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-2]])
        a = a - np.linalg.solve(m, g)
    return a


@dataclass
class Scorer:
    """Weights of both views, their calibration, and how much each counts."""

    text: np.ndarray
    meta: np.ndarray
    text_fit: np.ndarray
    meta_fit: np.ndarray
    mixed: np.ndarray
    passed: int = 0

    def views(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = logits(xt, self.text), logits(xm, self.meta)
        return self.text_fit[0] * a + self.text_fit[1], self.meta_fit[0] * b + self.meta_fit[1]

    def __call__(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.views(xt, xm)
        s = self.mixed[0] * a + self.mixed[1] * b + self.mixed[2]
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (s, a, b))


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, kept: np.ndarray, rounds: int = ROUNDS, sure: float = SURE, pool: Rows | Table | None = None) -> Scorer:
    """A scorer from the two views of the same rows; y is 1, 0, or -1 where unlabelled. Rows of `kept` only calibrate.

    In each round either view passes on all unlabelled rows that it is sure of; a row keeps the first label it gets from a view.
    The unlabelled rows are those of pool, or else those of y.
    """
    pool = pool or Rows(xt[(y < 0) & ~kept], xm[(y < 0) & ~kept])
    own = (y >= 0) & ~kept
    ot, om, oy = xt[own].astype(float), xm[own].astype(float), y[own]
    w, n = [fit_logistic(ot, oy), fit_logistic(om, oy)], 0
    said: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])  # the weights of each round, which give the labels again
    for _ in range(rounds if len(set(oy.tolist())) == 2 else 0):  # without both classes no view is ever sure
        for past, v in zip(said, w, strict=True):
            past.append(v)
        mx, my, times = pool.meta_rows(said[0], sure)
        found = [0.0]

        def sums(v, found=found):
            got = pool.text_sums(v, said[1], sure)
            found[0] = got[0].sum()
            return tuple(a + b for a, b in zip(got, class_sums(logits(ot, v), oy, lambda d: d @ ot), strict=True))

        w = [fit_sums(sums, w[0]), fit_logistic(np.concatenate([om, mx]), np.concatenate([oy, my]), times=np.concatenate([np.ones(len(oy)), times]))]
        n = int(found[0] + times.sum())
    at = kept & (y >= 0)
    fits = [fit_platt(logits(x[at], v), y[at]) if at.any() else np.array([1.0, 0.0]) for x, v in zip((xt, xm), w, strict=True)]
    out = Scorer(w[0], w[1], fits[0], fits[1], np.array([0.5, 0.5, 0.0]), n)
    if len(set(y[at].tolist())) == 2:
        a, b = out.views(xt[at], xm[at])
        best = min(np.linspace(0, 1, 21), key=lambda m: _loss(m * a + (1 - m) * b, y[at]))
        out.mixed = np.array([best, 1 - best, 0.0])
    return out


def _loss(s: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -s, s))))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lines = F.regexp_count(F.col(text_col), F.lit("\n")) + 1
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("source").alias("source"), F.col("lang").alias("lang"), F.length(text_col).cast("long").alias("n"), lines.cast("long").alias("lines"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: str = "quality") -> Scorer:
    """Co-trained on about LABELLED labelled rows, chosen by a hash of the id, which bounds the driver's part, and all unlabelled ones.

    Several labels of an id count as the one that most have, a tie as 0; null labels do not count.
    """
    small_batches(docs.sparkSession)
    named = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) > 0.5).cast("int").alias("y"))
    n_labels = labels.count()
    u = unit_hash(seed, F.col("id"))
    rows = _rows(docs, id_col, text_col)
    labelled = rows.where(u < LABELLED / max(1, n_labels)).join(named.where(u < LABELLED / max(1, n_labels)), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.to_pydict()
            xt = [text_features(t).astype("<f2").tobytes() for t in got["text"]]
            xm = [meta_features(*v).astype("<f2").tobytes() for v in zip(got["source"], got["lang"], got["n"], got["lines"], strict=True)]
            order = [zlib.crc32(f"{i}".encode()) for i in got["id"]]
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(got["y"], pa.int32()), pa.array(xt, pa.binary()), pa.array(xm, pa.binary())], ["h", "y", "xt", "xm"])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.to_pydict()
            xt = [text_features(t).astype("<f2") for t in got["text"]]
            at = [np.flatnonzero(x) for x in xt]
            xm = [np.flatnonzero(meta_features(*v)).astype(np.uint8).tobytes() for v in zip(got["source"], got["lang"], got["n"], got["lines"], strict=True)]
            cols = [[k.astype("<u2").tobytes() for k in at], [x[k].tobytes() for x, k in zip(xt, at, strict=True)], xm]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.binary()) for c in cols)], ["id", "xi", "xv", "xm"])

    got = labelled.mapInArrow(freeing(features), "h long, y int, xt binary, xm binary").collect()
    got.sort(key=lambda r: (r["h"], r["y"], bytes(r["xt"]), bytes(r["xm"])))
    xt, xm = (np.frombuffer(b"".join(r[c] for r in got), "<f2").astype(np.float32).reshape(len(got), d) for c, d in (("xt", TEXT_DIMS), ("xm", META_DIMS)))
    y, kept = np.array([r["y"] for r in got], int), np.array([r["h"] % 4 == 0 for r in got], bool)
    pool = None
    if len(set(y[~kept].tolist())) == 2:
        kind = f"id {docs.schema[id_col].dataType.simpleString()}, xi binary, xv binary, xm binary"
        with_id, without = (rows.where(c).mapInArrow(freeing(sparse), kind) for c in ("id IS NOT NULL", "id IS NULL"))
        pool = Table(cut(with_id.join(named, "id", "left_anti").unionByName(without).drop("id"), "quality"))
    return co_train(xt, xm, y, kept, pool=pool)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row for each of docs: (id, score, text_score, meta_score, kept), kept meaning a score of `least` or more.

    Null texts and metadata have features of their own, a null or blank text no words. Equal rows get equal scores.
    Columns other than id, text, source and lang are not read. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                got = batch.slice(at, 512).to_pydict()
                xt = np.stack([text_features(t) for t in got["text"]])
                xm = np.stack([meta_features(*v) for v in zip(got["source"], got["lang"], got["n"], got["lines"], strict=True)])
                p, a, b = s(xt, xm)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array(p), pa.array(a), pa.array(b), pa.array(p >= least)], ["id", "score", "text_score", "meta_score", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _rows(docs, id_col, text_col).mapInArrow(freeing(run), f"id {kind}, score double, text_score double, meta_score double, kept boolean")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scorer = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, scorer).withColumnRenamed("id", "doc_id")
