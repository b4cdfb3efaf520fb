"""python -m scrollmill.cli FOLDER: compress all sessions of a folder, report, and check; exit code 1 if anything is wrong."""

from __future__ import annotations

import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from pyspark.sql import functions as F

from scrollmill.operators.shingle import shingle_latency
from scrollmill.plans.compress import MINIFY, compress, messages_of, traced
from scrollmill.plans.integrity import check_integrity
from scrollmill.plans.report import grand_total, latency_summary, pass_totals, session_rows, timed
from scrollmill.sources.sessions import read_sessions
from scrollmill.storage import cut

#: Issues that are printed; their number is always told.
SHOWN = 50


def main(folder: str, spark: SparkSession | None = None) -> int:
    spark = spark or SparkSession.builder.appName("scrollmill").getOrCreate()
    try:
        t = read_sessions(spark, folder)
        if t.messages.isEmpty():
            print(f"No sessions in {folder}")
            return 0
    except AnalysisException as e:
        print(f"{folder} cannot be read: {e.getCondition()}")
        return 1
    outs, stats = traced(t, extra=[MINIFY])
    out, default = outs[-2], stats.where(F.col("pass") != MINIFY[0])
    issues = cut(check_integrity(t.messages, messages_of(out, t)), "issues")
    rows = session_rows(default, t.messages, issues)
    for r in rows.orderBy("session_id").toLocalIterator():
        print(f"{r['session_id']}: {r['messages']} messages, {r['bytes_before']} -> {r['bytes_after']} bytes (-{r['ratio']:.2f}%), {r['tokens_before']} -> {r['tokens_after']} tokens, {'ok' if r['ok'] else 'FAIL'}")
    pass_totals(stats).orderBy("pass_no").show(truncate=False)
    totals = [grand_total(session_rows(x, t.messages, issues)).select(F.lit(name).alias("passes"), "*") for name, x in (("default", default), ("with " + MINIFY[0], stats))]
    totals[0].unionByName(totals[1]).show(truncate=False)
    latency_summary(shingle_latency(outs[3])).show(truncate=False)  # after pass D
    n = totals[0].first()["bytes_before"]
    for r in timed({"all passes": lambda: messages_of(compress(t), t).write.format("noop").mode("overwrite").save()}, n):
        print(f"{r['name']}: {r['total_ms']:.2f} ms, {r['ms_per_kb']:.4f} ms/KB")
    bad = issues.count()
    for r in issues.limit(SHOWN).collect():
        print(f"{r['session_id']}: {r['issue']}")
    print(f"Integrity: FAIL, {bad} issues" if bad else "Integrity: all sessions passed")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:2]))
