import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus(spark):
    """Odd cases beside plain ones: nulls, empty and very long texts, copies, near copies, repeated rows, shared passages."""
    rng = random.Random(5)
    texts = [None, "", " ", "One two", "one two", "A b c d e", "x" * 300, "short\n\nlines\n\n\n"]
    base = words(rng, 120)
    for k in range(60):  # a group of near copies around the threshold
        own = list(base)
        for _ in range(k % 7):
            own[rng.randrange(120)] = f"y{rng.randrange(9)}"
        texts.append(" ".join(own))
    texts += [texts[10]] * 25
    passage = " ".join(words(rng, 60))
    texts += [" ".join(words(rng, 40)) + "\n" + passage + "\n" + " ".join(words(rng, 30)) for _ in range(12)]
    texts += ["\n".join(" ".join(words(rng, 6, 30)) for _ in range(12)) for _ in range(30)]
    texts += ["é😀中   ü", " ".join(words(rng, 9000)), "ab" * 4000]
    rows = [(i, t, None if i % 9 == 0 else "en", [None, "", "src1", "src0", "ß"][min(4, rng.randrange(9))], None) for i, t in enumerate(texts)]
    rows.append(rows[20])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
