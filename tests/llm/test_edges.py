"""Null and repeated ids, clashing names and extra columns, over all operators at once."""

import pytest
from pyspark.sql import functions as F

from scrollmill.llm import bpe, exact_dedup, langid, line_dedup, media, minhash_dedup, mixing, pii, quality, suffix_dedup

#: Names that operators use inside, or add.
NAMES = [
    "id", "row", "sha", "h", "n", "key", "plan", "copy", "copies", "bucket", "cell", "kept", "gone", "fp", "runs", "start", "base", "added", "component", "class", "digest", "bands", "packed", "label", "batch",
    "ids", "found", "rate", "u", "size", "src", "target", "__share", "__mix", "__t", "__copy", "__src", "__lang", "__lines", "__id", "__gone", "__keep_id", "__sha", "xi", "xm", "media", "text_sha256", "group_size",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "one two three four five six\nx\ny\nz", "en", "a", 3), (1, "another text with this very id\nx\ny\nz", "en", "a", 3), (None, "one two three four five six\nx\ny\nz", "de", None, None),
        (None, None, None, None, None), (2, "", "en", "b", 0), (2, "", "en", "b", 0), (3, "mail jo@example.com " * 3, "de", "b", 1), (4, "x" * 70000, "en", "", 1), (5, "é" * 60 + " 😀", None, "a", 2), (6, "é" * 60 + " 😀", "de", "a", 2),
    ]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    return plain, plain.withColumns({c: F.lit(f"own {k}") for k, c in enumerate(NAMES)})


OPERATORS = {
    "op1": lambda d, labels: mixing.plan_mix(d).select("doc_id", "__mix.*"),
    "op2": lambda d, labels: quality.score(d, quality.learn(d, labels)),
    "op3": lambda d, labels: minhash_dedup.near_components(d),
    "op4": lambda d, labels: exact_dedup.mark_copies(d),
    "op5": lambda d, labels: bpe.round_trip(d, bpe.default_vocabulary()),
    "op6": lambda d, labels: media.digest(d),
    "op7": lambda d, labels: langid.identify(d, langid.learn(d)).select("doc_id", "__lang.*"),
    "op8": lambda d, labels: suffix_dedup.remove_repeats(d),
    "op9": lambda d, labels: line_dedup.mark_repeated_lines(d, least_words=5).select("doc_id", "__lines.*"),
    "op10": lambda d, labels: pii.mark_private(d).select("id", "base", "added"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(spark, docs, name):
    plain, named = docs
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 0), (4, None)], "doc_id long, quality int")
    want, got = OPERATORS[name](plain, labels), OPERATORS[name](named, labels.withColumn("id", F.lit("x")).withColumn("y", F.lit(1)))
    assert want.columns == got.columns and want.count() == plain.count()
    assert sorted(map(repr, want.collect())) == sorted(map(repr, got.collect()))


@pytest.mark.parametrize("drop", [mixing.mix, exact_dedup.drop_copies, minhash_dedup.drop_near_copies, lambda d: langid.keep_known(d, langid.learn(d))])
def test_rows_keep_their_columns(docs, drop):
    plain, named = docs
    want, got = drop(plain), drop(named)
    assert got.columns == named.columns
    rows = got.collect()
    assert sorted(map(repr, want.collect())) == sorted(repr(type(r)(**{c: r[c] for c in plain.columns})) for r in rows)
    assert rows and all(r[c] == f"own {k}" for r in rows for k, c in enumerate(NAMES))
