"""Near-duplicate detection with b-bit MinHash.

A document's minima under many hash functions make band keys; documents that share one are candidates. The low bits of
the minima are packed: where two packed signatures differ is counted bit by bit and corrected for chance agreement,
which gives an estimate that drops candidates far below the threshold. Links are confirmed on the full shingle sets.

Documents with equal sets are one class, of which one row is compared. In a bucket, members are first held against one
hub. Only members that are still in different components are then compared, in blocks, so that a large group of near
copies costs its members times the few that stand apart; no bucket is ever in one place, and pairs that are no links never
leave their block. Packed signatures are exchanged first, texts only of members that seem like one of another component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollmill.llm.common import cut, drop_rows, freeing, join_split, small_batches, text_digest
from scrollmill.llm.components import components
from scrollmill.llm.shingles import MULTIPLIER, mix64, shingle_sets, slices

#: 32 bands of 5: a pair at similarity 0.85 shares none with a chance of 1e-8.
BANDS, ROWS, BITS = 32, 5, 4
#: Candidates estimated this many standard deviations below the threshold are dropped.
SIGMAS = 5.0
#: Members of a block, and bytes of their texts; a longer text stands alone.
BLOCK, BLOCK_BYTES = 256, 4 << 20


def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * MULTIPLIER)
    return (r[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (r[1::2] >> np.uint64(32)).astype(np.uint32)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of non-empty sets: (sets, BANDS * ROWS)."""
    a, b = _functions()
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(a), len(sets)), np.uint32)
    v = np.empty_like(x)
    for k in range(len(a)):
        np.bitwise_xor(x, b[k], out=v)
        np.multiply(v, a[k], out=v)
        np.minimum.reduceat(v, starts, out=out[k])
    return out.T.copy()


def band_keys(m: np.ndarray) -> np.ndarray:
    parts = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * MULTIPLIER, parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix64(key * MULTIPLIER + parts[:, :, k])
    return key.view(np.int64)


def pack(m: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, 64 / BITS of them a word."""
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(m), -1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def _similarity(x: np.ndarray) -> np.ndarray:
    """From where packed signatures differ (last axis), their similarity, corrected for low bits that agree by chance."""
    for s in (2, 1):  # gather a minimum's differing bits in its lowest
        x |= x >> np.uint64(s)
    x &= np.uint64(0x1111111111111111)
    agree = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / (BANDS * ROWS)
    chance = 1 / (1 << BITS)
    return (agree - chance) / (1 - chance)


def estimate(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Similarity of each packed signature of p with each of q."""
    return _similarity(p[:, None, :] ^ q[None, :, :])


def estimate_each(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Similarity of each packed signature of p with that of q in the same row."""
    return _similarity(p ^ q)


def floor_of(threshold: float) -> float:
    """The estimate below which a pair is dropped."""
    chance = 1 / (1 << BITS)
    agree = chance + (1 - chance) * threshold
    return threshold - SIGMAS * (agree * (1 - agree) / (BANDS * ROWS)) ** 0.5 / (1 - chance)


def sign(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, sha, n_shingles, digest, bands, packed) of each whole text; the last three are null without shingles, sha tells texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                sets = shingle_sets(batch.column(2).slice(lo, hi - lo), width)
                some = [s for s in sets if len(s)]
                keys, packed = [], []
                if some:
                    m = minima(some)
                    keys, packed = band_keys(m).tolist(), [row.tobytes() for row in pack(m)]
                ks, ps = iter(keys), iter(packed)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(ks) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        pa.array([next(ps) if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["id", "sha", "n_shingles", "digest", "bands", "packed"],
                )

    told = docs.select(F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("sha"), F.col(text_col).alias("text"))
    return told.mapInArrow(freeing(run), "id long, sha binary, n_shingles long, digest binary, bands array<long>, packed binary")


def _beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs (a, b, ...) with the column of table (id, column) for either, as column_a and column_b; b may be in very many pairs."""
    n = cut(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "hubs")
    told = table.select(F.col("id").alias("b"), F.col(column).alias(f"{column}_b")).join(n, "b")
    half = join_split(pairs, told, ["b"], "n", ["a"], known=tuple(n.agg(F.sum("n"), F.max("n")).first())).drop("n")
    return half.join(table.select(F.col("id").alias("a"), F.col(column).alias(f"{column}_a")), "a")


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that seem alike by their packed signatures."""
    least = floor_of(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(batch), -1) for c in ("packed_a", "packed_b"))
                keep = pa.array(estimate_each(x, y) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return _beside(pairs, reps, "packed").mapInArrow(freeing(run), "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; texts: (id, text), one row an id.

    A pair without one of its texts is dropped, a repeated pair stays repeated, a null or empty text is like none.
    """
    both = _beside(pairs, texts, "text").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                met: dict[str, np.ndarray] = {}

                def sets(texts: pa.Array, met=met) -> list[np.ndarray]:
                    new = list(dict.fromkeys(t for t in texts.to_pylist() if t not in met))
                    met.update(zip(new, shingle_sets(pa.array(new, pa.string()), width), strict=True))
                    return [met[t] for t in texts.to_pylist()]

                same = []
                for x, y in zip(sets(part.column(2)), sets(part.column(3)), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    same.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                keep = pa.array(same, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(freeing(run), "a long, b long")


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (band, key, id, label) of buckets that hold several components, with the bucket's size n and the label most have."""
    if labels is not None:
        members = members.join(labels.withColumnRenamed("component", "label"), "id", "left")
    else:
        members = members.withColumn("label", F.col("id"))
    members = members.withColumn("label", F.coalesce("label", "id"))
    by_label = members.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first"))
    rank = F.struct("c", -F.col("label"))
    top = by_label.groupBy("band", "key").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds"), F.max_by("label", rank).alias("most"), F.max_by("first", rank).alias("hub"), F.max("c").alias("n_most")
    )
    return join_split(members, cut(top.where("kinds > 1").drop("kinds"), "open-buckets"), ["band", "key"], "n", ["id"])


def _star(opened: DataFrame) -> DataFrame:
    """Of each member outside its bucket's main component, the hub that it meets in most bands: (a, b)."""
    met = opened.where("label <> most").groupBy("id", "hub").count()
    return met.groupBy("id").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("b")).withColumnRenamed("id", "a")


def _cells(members: DataFrame, group: list[str], across, down, cols: list[str]) -> DataFrame:
    """Members of each group dealt into cells (group, i, j), sorted by cell: block i of `down` of those outside the group's
    main component (asks) meets block j of `across` of all. Each pair of a group with one outside meets in one cell."""
    asks = members.where("label <> most").select(*group, *cols, F.lit(True).alias("asks"), F.pmod(F.xxhash64("id"), down).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), across - 1)).alias("j"))
    told = members.select(*group, *cols, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), down - 1)).alias("i"), F.pmod(F.xxhash64("id"), across).cast("int").alias("j"))
    return asks.unionByName(told).repartition(*group, "i", "j").sortWithinPartitions(*group, "i", "j")


def _blocks(n):
    return F.greatest(F.ceil(n / F.lit(BLOCK)), F.lit(1)).cast("int")


def _cell_by_cell(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each cell, from batches sorted by cell."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in key], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(keys[lo])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Components of labels."""

    def __init__(self, labels: np.ndarray):
        names, self.place = np.unique(labels, return_inverse=True)
        self.root = np.arange(len(names))

    def join(self, x: int, y: int) -> bool:
        """Whether rows x and y were apart."""
        a, b = self.root[self.place[x]], self.root[self.place[y]]
        if a == b:
            return False
        self.root[self.root == b] = a
        return True

    def roots(self, rows: np.ndarray) -> np.ndarray:
        return self.root[self.place[rows]]


def _plausible(opened: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b, id): labels of which members share a bucket and seem alike, enough of them to connect all such labels; and, in rows of their own, these members.

    A pair is told of in the first band alone that it shares, where its labels differ as they do in all.
    """
    full = opened.join(reps.select("id", "packed", "bands"), "id").withColumn("bands", F.slice("bands", F.lit(1), F.col("band")))
    cells = _cells(full, ["band", "key"], _blocks(F.col("n")), _blocks(F.col("n") - F.col("n_most")), ["id", "label", "packed", "bands"])
    least = floor_of(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cell_by_cell(batches, ["band", "key", "i", "j"]):
            ids, labels, asks = (t.column(c).to_numpy() for c in ("id", "label", "asks"))
            packed = np.frombuffer(b"".join(t.column("packed").to_pylist()), np.uint64).reshape(len(labels), -1)
            before = t.column("bands").combine_chunks()
            before = before.flatten().to_numpy().reshape(len(labels), -1)
            forest, told, out, some = Forest(labels), np.flatnonzero(~asks), [], set()
            for u in np.flatnonzero(asks).tolist():
                other = told[labels[told] != labels[u]]
                alike = other[estimate(packed[u : u + 1], packed[other])[0] >= least] if len(other) else other
                alike = alike[~(before[alike] == before[u]).any(axis=1)]
                if len(alike):
                    some.add(ids[u])
                    some.update(ids[alike].tolist())
                    for v in alike[forest.roots(alike) != forest.roots(np.array([u]))[0]].tolist():
                        if forest.join(u, v):
                            out.append((labels[u], labels[v], None))
            out += [(None, None, x) for x in some]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["a", "b", "id"])

    return cells.mapInArrow(freeing(run), "a long, b long, id long")


def _rest(opened: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between members of different labels, confirmed on the full sets; enough of them to connect all labels that links connect.

    Labels with members that seem alike make up groups. In each, those members outside the main component are held against
    all, block by block, with their texts at hand, so that no pair leaves its cell but those that join two labels.
    """
    found = cut(_plausible(opened, reps, percent), "plausible")
    groups = components(found.where("a is not null").select("a", "b")).select(F.col("id").alias("label"), F.col("component").alias("grp"))
    some = found.where("id is not null").select("id").distinct()
    members = opened.select("id", "label").distinct().join(some, "id").join(groups, "label")
    members = cut(members.join(texts.withColumn("size", F.octet_length("text").cast("long")), "id"), "open")
    top = members.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("bytes")).groupBy("grp")
    by = F.struct("c", -F.col("label"))
    top = top.agg(F.sum("c").alias("n"), F.max("c").alias("n_most"), F.sum("bytes").alias("bytes"), F.max_by("bytes", by).alias("bytes_most"), F.max_by("label", by).alias("most"))
    full = join_split(members, top, ["grp"], "n", ["id"]).join(reps.select("id", "packed"), "id")
    size = lambda n, bytes: F.greatest(_blocks(n), F.ceil(bytes / F.lit(BLOCK_BYTES)).cast("int"))
    across, down = size(F.col("n"), F.col("bytes")), size(F.col("n") - F.col("n_most"), F.col("bytes") - F.col("bytes_most"))
    cells = _cells(full, ["grp"], across, down, ["id", "label", "packed", "text"])
    least = floor_of(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cell_by_cell(batches, ["grp", "i", "j"]):
            ids, labels, asks = (t.column(c).to_numpy() for c in ("id", "label", "asks"))
            packed = np.frombuffer(b"".join(t.column("packed").to_pylist()), np.uint64).reshape(len(ids), -1)
            texts = t.column("text").combine_chunks()
            sets = [x for lo, hi in slices(texts) for x in shingle_sets(texts.slice(lo, hi - lo), width)]
            known, place = np.unique(np.concatenate(sets), return_inverse=True)
            place = np.split(place, np.cumsum([len(x) for x in sets])[:-1])
            has = np.zeros(len(known), bool)
            forest, told, out = Forest(labels), np.flatnonzero(~asks), []
            for u in np.flatnonzero(asks).tolist():
                apart = told[forest.roots(told) != forest.roots(np.array([u]))[0]]
                if not len(apart):
                    continue
                has[place[u]] = True
                for v in apart[estimate(packed[u : u + 1], packed[apart])[0] >= least].tolist():
                    both = int(has[place[v]].sum())
                    if 100 * both >= percent * (len(place[u]) + len(place[v]) - both) and forest.join(u, v):
                        out.append((ids[u], ids[v]))
                has[place[u]] = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return cells.mapInArrow(freeing(run), "a long, b long")


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, sha, row, n_shingles, component, component_id) of each of docs; row tells rows apart, component is null for a row that has no like."""
    small_batches(docs.sparkSession)
    signed = cut(sign(docs, id_col, text_col, width).withColumn("row", F.monotonically_increasing_id()), "signed")
    # The first row of a class of equal sets stands for it and gives it its number. Ids need not be unique or known.
    classes = cut(signed.where("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("class"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    firsts = classes.select(F.col("class").alias("row"))
    reps = cut(signed.join(firsts, "row", "left_semi").select(F.col("row").alias("id"), F.col("id").alias("doc"), "sha", "bands", "packed"), "representatives")
    spread = reps.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = cut(spread.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = cut(join_split(spread, buckets, ["band", "key"], "n", ["id"]).drop("n"), "members")
    wanted = reps.join(members.select("id").distinct(), "id", "left_semi").select("id", "doc", "sha")
    own = docs.select(F.col(id_col).cast("long").alias("doc"), text_digest(F.col(text_col)).alias("sha"), F.col(text_col).alias("text"))
    same = own["doc"].eqNullSafe(wanted["doc"]) & (own["sha"] == wanted["sha"])
    texts = cut(own.join(wanted, same).select("id", "text").dropDuplicates(["id"]), "texts")

    links: DataFrame | None = None
    labels: DataFrame | None = None
    for step in ("star", "rest"):
        opened = _open(members, labels)
        if step == "star":
            found = confirm(cut(likely(cut(_star(opened), "star"), reps, percent), "likely"), texts, width, percent)
        else:
            found = _rest(cut(opened, "apart"), reps, texts, width, percent)
        found = cut(found, "confirmed")
        # What is known of earlier links is in the labels.
        links = found if labels is None else found.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
        labels = cut(components(links), "labels")
    assert labels is not None
    linked = classes.join(labels.withColumnRenamed("id", "class"), "class")
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    linked = join_split(linked, ids, ["component"], "classes", ["class"]).select("digest", "component", "component_id")
    named = classes.join(linked, "digest", "left")
    named = named.select("digest", "n", F.coalesce("component", F.when(F.col("n") > 1, F.col("class"))).alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    rows = signed.select("id", "sha", "row", "n_shingles", "digest")
    some = join_split(rows.where("digest is not null"), cut(named, "named"), ["digest"], "n", ["row"]).drop("n", "digest")
    none = rows.where("digest is null").drop("digest").select("*", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id"))
    return some.unionByName(none)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each of docs: id_col, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of `width`-word shingles; component_id is
    the least id that links lead to, kept says whether it is the row's own. Ids are integers. A null, empty or blank text
    has no shingle and no link, and so stays; fewer words than `width` make one shingle. Rows are documents of their own,
    whether or not they repeat an id, a text, or both: links are between texts. A null id is none: it is linked like any
    other, and where all ids that links lead to are null, component_id is null and all these rows are kept. Other columns
    are not looked at. No rows: no rows.
    """
    out = _components(docs, id_col, text_col, width, percent)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns, whatever these are named.

    That with the least id stays, null ids being the largest; of several texts of that id one, and of equal rows one. Texts
    without words stay unless a row repeats their id and text. No rows: no rows.
    """
    found = cut(_components(docs, id_col, text_col, width, percent), "components")
    # A text without links is a component of its own.
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("sha"))
    first = found.where("component is not null").groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    grouped = join_split(found.where("component is not null"), first, ["component"], "n", ["row"])
    verdicts = grouped.select("id", "sha", order.eqNullSafe(F.col("first")).alias("kept")).unionByName(found.where("component is null").select("id", "sha", F.lit(True).alias("kept")))
    return drop_rows(docs, id_col, text_col, verdicts)


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


ORACLE_OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(x[i:i + 4], ' ') AS g FROM (SELECT doc_id, x, unnest(range(1, greatest(len(x) - 3, 2))) AS i FROM w WHERE len(x) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT f.b, r.root FROM r JOIN f ON r.v = f.a)
SELECT v AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id, v = min(root) AS kept
FROM r LEFT JOIN n ON n.doc_id = v GROUP BY v
"""
