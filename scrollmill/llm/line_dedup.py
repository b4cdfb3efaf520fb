"""Line dedup by winnowing; DataFrame functions only.

Lines are hashed, k consecutive hashes make a gram, and of each w consecutive grams the least, the last one of several,
is a fingerprint. Only fingerprints leave a document. Two documents that share a run of t = w + k - 1 lines share a
fingerprint at the same place in it. Places of one fingerprint are matched and extended both ways, to each run of t lines
around it; of such a run all places but the first are deleted. A longer run is put together from matches that overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrollmill.llm.common import WORD, cut, join_split, packed_row

#: Words from which one line, or a run of fewer lines than the window has, counts as a run in op9_passage_dedup.
PASSAGE_WORDS = 51


def _digest(start: Column, n: Column) -> Column:
    """A digest of n lines of `ls`."""
    return F.unhex(F.md5(F.array_join(F.slice("ls", start + 1, n), "\n")))


def fingerprints(lines: DataFrame, gram: int, window: int) -> DataFrame:
    """(id, h, fp, runs [(digest, start, len)]) of documents (id, h, ls): one row for each gram chosen, with the runs of gram + window - 1 lines that it lies in."""
    run = gram + window - 1
    x = lines.where(F.size("ls") >= run).withColumn("lh", F.transform("ls", lambda s: F.xxhash64(s)))
    x = x.withColumn("g", F.transform(F.sequence(F.lit(0), F.size("lh") - gram), lambda i: F.xxhash64(F.slice("lh", i + 1, gram))))

    def chosen(j):
        """The place of the least of the window's grams, the last of several."""
        back = F.reverse(F.slice("g", j + 1, window))
        return (j + window - F.array_position(back, F.array_min(back))).cast("int")

    x = x.withColumn("at", F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("g") - window), chosen)))

    def around(p):
        starts = F.sequence(F.greatest(p - (window - 1), F.lit(0)), F.least(p, F.size("ls") - run))
        return F.transform(starts, lambda s: F.struct(_digest(s, F.lit(run)).alias("digest"), s.alias("start"), F.lit(run).alias("len")))

    picked = F.explode(F.transform("at", lambda p: F.struct(F.get("g", p).alias("fp"), around(p).alias("runs"))))
    return x.select("id", "h", picked.alias("p")).select("id", "h", "p.*")


def passages(lines: DataFrame, run: int, least_words: int) -> DataFrame:
    """As fingerprints, of each shortest run of fewer than run lines that has least_words words, and of each document of fewer lines: these are their own fingerprints.

    A run is a shortest one if it no longer counts without its last line, or without its first. Every line of a longer
    run that counts lies in one of either kind, or in a run of run lines; which runs are shortest depends on their own
    lines alone.
    """
    x = lines.withColumn("wc", F.transform("ls", lambda s: F.regexp_count(s, F.lit(WORD))))
    n = F.size("ls")

    def shortest(j, step):
        """Lines of the shortest run from line j on (step 1) or up to it (step -1); null if none counts."""
        total, found = F.lit(0), F.when(F.lit(False), F.lit(0))
        for k in range(run):
            at = j + step * k
            total = total + F.when((at >= 0) & (at < n), F.get("wc", at))  # null beyond the text
            found = F.coalesce(found, F.when(total.isNotNull() if k == run - 1 else total >= least_words, F.lit(k + 1)))
        return found

    lines, base = F.sequence(F.lit(0), n - 1), run + 1
    packed = lambda start, size: start.cast("long") * base + size  # noqa: E731  # a number: equal structs would be sought pair by pair
    ahead = F.transform(lines, lambda j: packed(j, shortest(j, 1)))
    behind = F.transform(lines, lambda j: F.transform(F.array(shortest(j, -1)), lambda k: packed(j - k + 1, k))[0])
    whole = F.array(F.when((n < run) & (F.array_join("ls", "\n") != ""), packed(F.lit(0), n)))
    runs = F.filter(F.array_distinct(F.concat(ahead, behind, whole)), lambda r: r.isNotNull() & (r % base < run))
    x = x.select("id", "h", "ls", F.transform(runs, lambda r: F.struct((r / base).cast("int").alias("start"), (r % base).cast("int").alias("len"))).alias("runs"))
    told = F.explode(F.transform("runs", lambda r: F.struct(_digest(r["start"], r["len"]).alias("digest"), r["start"].alias("start"), r["len"].alias("len"))))
    x = x.select("id", "h", told.alias("r"))
    return x.select("id", "h", F.xxhash64("r.digest").alias("fp"), F.array("r").alias("runs"))


def _repeated(places: DataFrame) -> DataFrame:
    """(id, h, gone): the lines of each document that lie in runs which have come before; places as fingerprints makes them."""
    places = cut(places, "fingerprints")
    again = places.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    matched = join_split(places, again, ["fp"], "n", ["id", "h", "runs"]).select("id", "h", "fp", F.explode("runs").alias("r")).select("id", "h", "fp", "r.*")
    matched = cut(matched, "matches")
    key, place = ["fp", "digest"], F.struct("id", "start")
    first = matched.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
    first = first.where(F.col("first") < F.col("last")).drop("last")
    later = join_split(matched, first, key, "n", ["id", "h", "start"]).where(place > F.col("first"))
    gone = later.groupBy("id", "h").agg(F.collect_set(F.struct("start", "len")).alias("runs"))
    return gone.select("id", "h", F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["len"] - 1)))).alias("gone"))


def mark_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = 2, window: int = 2, least_words: int | None = None) -> DataFrame:
    """docs with one more column `__lines`, which replaces one of that name: struct(n_lines, n_removed, kept).

    A line goes if it lies in a run of gram + window - 1 lines that also starts at an earlier place, places being ordered
    by id, then line; overlaps count, and runs are judged on the input. Lines end at a line feed; a null text counts as
    empty, which is one empty line. Shorter documents stay whole. A null id comes before all others. Rows that repeat an
    id and its text share their verdict; those that repeat an id with another text are documents of their own, of which
    none comes before the other at the same line. Other columns stay as they are. No rows: no rows.

    With least_words, a run of fewer lines counts too if it has that many words, and so does the whole of a document of
    fewer lines, against other places that count. A document's lines are handled by one task, whole.
    """
    run = gram + window - 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.split(text, "\n").alias("ls"))
    places = fingerprints(lines, gram, window)
    if least_words is not None:
        places = places.unionByName(passages(lines, run, least_words))
    gone = _repeated(places)
    packed = docs.select(packed_row(docs).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))
    out = packed.join(gone, packed["id"].eqNullSafe(gone["id"]) & (packed["h"] == gone["h"]), "left")
    out = out.select("row", F.coalesce(F.col("row")[text_col], F.lit("")).alias("text"), "gone")
    ls = F.split("text", "\n")
    at = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(at, lambda i: F.get(ls, i)), "\n"))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    told = F.struct(F.size(ls).cast("long").alias("n_lines"), removed.alias("n_removed"), kept.alias("kept"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "__lines"], told.alias("__lines"))


def _shown(marked: DataFrame) -> DataFrame:
    return marked.select("doc_id", "__lines.n_lines", "__lines.n_removed", F.sha2("__lines.kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Runs of three lines and more alone, as its SQL has it."""
    return _shown(mark_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def op9_passage_dedup(spark, sf_dir: str) -> DataFrame:
    """Also long passages on one or two lines, and whole documents that short."""
    return _shown(mark_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), least_words=PASSAGE_WORDS))


ORACLE_OP9 = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
w AS (SELECT doc_id, i AS start, x[i] || chr(10) || x[i + 1] || chr(10) || x[i + 2] AS win FROM (SELECT doc_id, x, unnest(range(1, len(x) - 1)) AS i FROM l)),
a AS (SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) AS k FROM w),
g AS (SELECT doc_id, list(DISTINCT start + o) AS gone FROM a, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1 GROUP BY doc_id)
SELECT l.doc_id, CAST(len(x) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(x, chr(10))
                   ELSE coalesce(array_to_string(list_filter(x, lambda e, i: NOT list_contains(gone, i)), chr(10)), '') END) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""

#: Runs of three lines, shorter ones of 51 words, and whole documents of fewer lines.
ORACLE_OP9_PASSAGES = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
r AS (SELECT doc_id, i AS start, n, array_to_string(x[i:i + n - 1], chr(10)) AS win, len(x) AS total
      FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM l), (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(x)),
w AS (SELECT doc_id, start, n, win FROM r
      WHERE n = 3 OR (n = total AND win <> '') OR len(regexp_extract_all(win, '[^\x20\x09-\x0D]+')) >= 51),
a AS (SELECT doc_id, start, n, row_number() OVER (PARTITION BY n, win ORDER BY doc_id, start) AS k FROM w),
g AS (SELECT doc_id, list(DISTINCT start + o) AS gone FROM a, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1 AND o < n GROUP BY doc_id)
SELECT l.doc_id, CAST(len(x) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(x, chr(10))
                   ELSE coalesce(array_to_string(list_filter(x, lambda e, i: NOT list_contains(gone, i)), chr(10)), '') END) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""
