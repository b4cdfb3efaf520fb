"""Runs of equal lines, trailing blanks and blank lines: functions of one text, within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrollmill.functions.blocks import is_text
from scrollmill.functions.text import json_string_len
from scrollmill.schema import Transcript

#: Equal lines that make a run.
LEAST_RUN = 3
HAS_RUN = r"(?:\A|\n)([^\n]*)\n\1\n\1(?=\n|\z)"


def run_starts(lines: Column) -> Column:
    """Where each maximal run of equal lines starts, and the number of lines at the end."""
    at = F.sequence(F.lit(0), F.size(lines) - 1)
    return F.concat(F.filter(at, lambda i: (i == 0) | (F.get(lines, i) != F.get(lines, i - 1))), F.array(F.size(lines)))


def collapse_runs(text: Column) -> Column:
    """Runs of LEAST_RUN lines and more as one line with their number."""
    lines = F.split(text, "\n")

    def collapsed(ls: Column, starts: Column) -> Column:
        def one(i: Column) -> Column:
            start, n = F.get(starts, i), F.get(starts, i + 1) - F.get(starts, i)
            return F.when(n >= LEAST_RUN, F.array(F.concat(F.get(ls, start), F.lit(" (×"), n.cast("string"), F.lit(")")))).otherwise(F.slice(ls, start + 1, n))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts) - 2), one)), "\n")

    # The lines and starts are bound once, as elements of an array of one.
    bound = F.transform(F.array(F.struct(lines.alias("ls"), run_starts(lines).alias("at"))), lambda x: collapsed(x["ls"], x["at"]))
    return F.when(text.rlike(HAS_RUN), F.get(bound, F.lit(0))).otherwise(text)


def strip_trailing(text: Column) -> Column:
    """Without spaces and tabs before a line feed or the end; a carriage return ends no line."""
    return F.regexp_replace(text, r"(?<![ \t])[ \t]++(?=\n|\z)", "")


def collapse_blank(text: Column) -> Column:
    """Three and more blank lines in a row as one."""
    whole = F.when(text.rlike(r"\A\n{2,}\z"), F.lit(""))
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\A\n{3,}+", "\n"), r"(?<!\n)\n{4,}+(?!\z)", "\n\n"), r"(?<!\n)\n{3,}+\z", "\n")
    return F.coalesce(whole, inner)


def map_text(t: Transcript, f) -> Transcript:
    """Text blocks with f of their text."""
    blocks = t.blocks.withColumn("__new", F.when(is_text(), f(F.col("text"))))
    grown = F.when(F.col("__new").isNull(), F.lit(0)).otherwise(json_string_len(F.col("__new")) - json_string_len(F.col("text")))
    changed = blocks.withColumns({"json_bytes": F.col("json_bytes") + grown, "text": F.coalesce("__new", "text")})
    return t.with_(blocks=changed.select(*t.blocks.columns))


def runlength(t: Transcript) -> Transcript:
    return map_text(t, collapse_runs)
