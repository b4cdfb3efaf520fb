"""Language identification by sparse multinomial logistic regression.

A text is its TF-IDF weighted character n-grams, hashed to a fixed number of features. The weights are learned with
follow-the-regularised-leader under an elastic-net penalty, which leaves most of them at zero. A temperature, fitted on
rows kept from training, turns the scores into calibrated probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.llm.common import freeing, packed_row, small_batches, unit_hash

#: Hashed features, and the longest n-gram.
DIMS, LONGEST = 1 << 15, 3
#: Rows of each language that training takes at most, on average; a language with fewer gives all it has.
ROWS_PER_LANGUAGE = 1000
#: Share of them that is kept for the temperature.
CALIBRATION = 0.2
UNKNOWN = "und"


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of the text's n-grams of 1 to LONGEST characters, lower-cased, and how often each occurs."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    grams, g = [], np.zeros(len(c), np.uint64)
    for k in range(min(LONGEST, len(c))):
        g = g[: len(c) - k] * np.uint64(0x100000001B3) + c[k:] + np.uint64(1)
        grams.append((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15))
    n = np.bincount(np.concatenate(grams).astype(np.int64), minlength=DIMS)
    at = np.flatnonzero(n)
    return at, n[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts(text)
    v = (1 + np.log(n)) * idf[at]
    return at, v / max(np.sqrt(v @ v), 1e-12)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights (classes, DIMS + 1), the last column being the bias, from rows (features, values, class), in the order given."""
    z, n = np.zeros((classes, DIMS + 1)), np.zeros((classes, DIMS + 1))

    def weights(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for at, v, y in rows:
            at, v = np.append(at, DIMS), np.append(v, 1.0)
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns)
            s = w @ v
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * v
            new = ns + g * g
            z[:, at] = zs + g - (np.sqrt(new) - np.sqrt(ns)) / alpha * w
            n[:, at] = new
    return weights(z, n)


def fit_temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss on a fixed grid."""

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]))

    return min(np.geomspace(0.05, 5, 93).tolist(), key=loss) if len(scores) else 1.0


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Model:
    """langs[i] is the language of weights[i]; without languages all texts are UNKNOWN."""

    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float):
        self.langs, self.weights, self.idf, self.temperature = langs, weights.T.astype(np.float32).copy(), idf, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        at, v = vector(text, self.idf)
        s = (v @ self.weights[at] + self.weights[DIMS]) / self.temperature
        p = np.exp(s - s.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts (text) each feature occurs, and their number; DIMS rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                if t := t.as_py():
                    df[counts(t)[0]] += 1
            df[DIMS] += len(batch)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["feature", "n"])

    df = np.zeros(DIMS + 1, np.int64)
    for r in texts.mapInArrow(freeing(run), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r["feature"]] = r["n"]
    return df[:DIMS], int(df[DIMS])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, seed: str = "langid") -> Model:
    """A model from the rows that are not held out and have a text with a letter and a language.

    Document frequencies are of all these rows. The weights are fitted on about rows_per_language rows of each
    language, chosen by a hash of the id: this bound keeps the driver's part the same at any size.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(per_lang)
    df, n = document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    rates = docs.sparkSession.createDataFrame([(x, min(1.0, rows_per_language / per_lang[x])) for x in langs] or [("", 0.0)], "lang string, rate double")
    u = unit_hash(seed, F.col("id"))
    # As many rows as the model has classes, whose weights go to all executors anyway.
    chosen = rows.join(F.broadcast(rates), "lang").where(u < F.col("rate")).select("text", "lang", unit_hash(seed + " order", F.col("id")).alias("u"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [vector(t, idf) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([a.astype("<u2").tobytes() for a, _ in pairs], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in pairs], pa.binary())],
                ["lang", "u", "at", "v"],
            )

    got = chosen.mapInArrow(freeing(vectors), "lang string, u double, at binary, v binary").collect()
    got.sort(key=lambda r: (r["u"], r["lang"], bytes(r["at"])))
    place = {x: i for i, x in enumerate(langs)}
    sample = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["v"], "<f4").astype(np.float64), place[r["lang"]]) for r in got]
    kept = int(len(sample) * CALIBRATION)
    weights = train_ftrl(sample[kept:] or sample, len(langs))
    scores = np.array([weights[:, at] @ v + weights[:, DIMS] for at, v, _ in sample[:kept]]).reshape(kept, len(langs))
    return Model(langs, weights, idf, fit_temperature(scores, np.array([y for *_, y in sample[:kept]], int)))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with one more column `__lang`, which replaces one of that name: struct(lang_pred, score), from the whole text alone.

    A null text, or one without a letter, is `und` with score 0. Equal texts get equal results. Other columns are kept
    as they are. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn("__lang", _predictor(docs.sparkSession, model)(F.col(text_col)))


def _predictor(spark: SparkSession, model: Model):
    """A function of a text column that gives struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)  # its size is fixed by DIMS and the number of languages

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from freeing(run)(batches)

    return predict


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language can be told, which replaces lang_col; other columns stay, whatever these are named.

    A null text, or one without a letter, goes. Rows are judged one by one. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    found = docs.select(packed_row(docs).alias("row"), _predictor(docs.sparkSession, model)(F.col(text_col)).alias("found"))
    known = found.where(F.col("found.lang_pred") != UNKNOWN)
    return known.select(*[F.col("found.lang_pred").alias(c) if c == lang_col else F.col("row")[c].alias(c) for c in docs.columns])


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "__lang.lang_pred", "__lang.score")
