import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrollmill.llm import langid

SYLLABLES = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["sch", "eit", "ung", "der"], "cc": ["eau", "oux", "tre", "ment"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, lang, rng.choice([1, 3, 20, 60])), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), [8, 2, 1], k=500))]
    rows += [(600, None, "aa"), (601, "", "bb"), (602, "12 %", "aa"), (603, text(rng, "bb", 20000), None), (604, rows[0][1], "cc"), (604, rows[0][1], "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    model = langid.learn(docs)
    return rows, docs, model, langid.identify(docs, model)


def test_held_out_rows_are_told_apart(found):
    rows, docs, _, out = found
    assert out.columns == [*docs.columns, "__lang"]
    got = out.withColumn("held", langid.held_out("doc_id")).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held"] and r["doc_id"] < 500]
    assert len(held) > 80
    assert sum(r["__lang"]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    sure = [r for r in held if r["__lang"]["score"] > 0.9]
    assert sum(r["__lang"]["lang_pred"] == r["lang"] for r in sure) / len(sure) > 0.97


def test_odd_texts(found):
    rows, _, _, out = found
    got = {r["doc_id"]: r["__lang"] for r in out.collect()}
    assert [tuple(got[i]) for i in (600, 601, 602)] == [("und", 0.0)] * 3
    assert got[603]["lang_pred"] == "bb"
    assert got[604] == got[0]
    assert all(0 <= x["score"] <= 1 for x in got.values())


def test_weights_are_sparse_and_reruns_agree(found):
    _, docs, model, _ = found
    again = langid.learn(docs.repartition(5))
    assert (again.weights == model.weights).all() and again.temperature == model.temperature
    assert (model.weights != 0).mean() < 0.1


def test_document_frequencies_cover_all_rows(found):
    _, docs, _, _ = found
    rows = [r["text"] for r in docs.where("text is not null and text <> ''").collect()]
    df, n = langid.document_frequencies(docs.where("text is not null and text <> ''").select("text"))
    want = np.zeros(langid.DIMS, int)
    for t in rows:
        want[langid.counts(t)[0]] += 1
    assert n == len(rows) and (df == want).all()


def test_weights_are_those_of_the_rule_step_by_step(found):
    """Follow-the-regularised-leader with one number at a time."""
    rows = found[0][:12]
    at_v = [langid.vector(t, np.ones(langid.DIMS)) for _, t, _ in rows]
    y = [sorted(SYLLABLES).index(lang) for *_, lang in rows]
    got = langid.train_ftrl([(a, v, k) for (a, v), k in zip(at_v, y, strict=True)], 3, epochs=2, alpha=0.7, beta=1.3, l1=0.03, l2=0.05)
    z, n = {}, {}

    def weight(c, f):
        zs, ns = z.get((c, f), 0.0), n.get((c, f), 0.0)
        return 0.0 if abs(zs) <= 0.03 else -(zs - math.copysign(0.03, zs)) / ((1.3 + math.sqrt(ns)) / 0.7 + 0.05)

    for _ in range(2):
        for (a, v), k in zip(at_v, y, strict=True):
            x = [*zip(a.tolist(), v.tolist(), strict=True), (langid.DIMS, 1.0)]
            w = [{f: weight(c, f) for f, _ in x} for c in range(3)]
            e = [math.exp(sum(w[c][f] * u for f, u in x)) for c in range(3)]
            for c in range(3):
                for f, u in x:
                    g = (e[c] / sum(e) - (c == k)) * u
                    old = n.get((c, f), 0.0)
                    z[c, f] = z.get((c, f), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / 0.7 * w[c][f]
                    n[c, f] = old + g * g
    want = np.zeros((3, langid.DIMS + 1))
    for c, f in z:
        want[c, f] = weight(c, f)
    assert np.allclose(got, want, atol=1e-12) and (want != 0).any()


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 400)
    scores = rng.normal(size=(400, 3)) * 4
    scores[np.arange(400), truth] += 2
    assert langid.fit_temperature(scores, truth) > 1
    assert langid.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_nothing_to_learn_from(spark, no_rows):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [tuple(r["__lang"]) for r in langid.identify(docs, langid.learn(docs)).collect()] == [("und", 0.0)] * 2
    assert langid.identify(no_rows, langid.learn(no_rows)).count() == 0
