"""Smaller text of the same meaning: trailing blanks, blank lines, and JSON without spaces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scrollmill.functions.jsjson import compact
from scrollmill.functions.text import JS_SPACE
from scrollmill.operators.runs import collapse_blank, map_text, strip_trailing
from scrollmill.schema import Transcript


def compact_json(text: Column) -> Column:
    """Texts that are one JSON object or array, compactly; only those that may be one are handed to Python."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else compact(t))

    maybe = text.rlike(rf"\A[{JS_SPACE}]*+[\[{{](?s:.*)[\]}}][{JS_SPACE}]*\z")
    return F.when(maybe, run(F.when(maybe, text))).otherwise(text)


def minify(t: Transcript) -> Transcript:
    return map_text(map_text(t, lambda text: collapse_blank(strip_trailing(text))), compact_json)
