"""Near duplicates: by lines in common, an earlier text of the session as a base, and a line diff against it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrollmill.functions.blocks import is_text
from scrollmill.functions.linediff import bag_similarity, diff_lines, render_diff
from scrollmill.functions.text import js_round, json_string_len, utf8_len
from scrollmill.schema import NearOptions, Transcript
from scrollmill.storage import cut

KEY = ["session_id", "ord"]
#: Counters by which tokens are put in order. Any order is right; the rarer the first ones, the fewer pairs meet.
SLOTS = 1 << 18
#: Texts that share a token and are more than FEW do not make pairs by it: they are compared in blocks, each two once. So are texts with more than PARTNERS others.
FEW, PARTNERS = 16, 2
#: Texts of a block, by bitmaps of so many bits and, from so many lines on, by counts of remainders. Of two blocks, the pairs are dealt to SPLIT * SPLIT parts.
BLOCK, BITS, LONG, SPLIT = 2048, 512, 256, 4
#: A limit that no number of lines reaches.
ANY = 1 << 31


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of hashed lines with so many lines, or one text."""
    for batch in batches:
        ends = batch.column(batch.schema.get_field_index("hashes")).offsets.to_numpy()
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of hashed lines (salt, hashes) the row of each and its token: a hash of the session, the line and the count of its occurrence, so that sets agree where bags do."""
    lists = batch.column(batch.schema.get_field_index("hashes"))
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    flat = flat.copy()
    for lo, hi in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True):
        flat[lo:hi].sort()
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    nth = np.arange(len(flat)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    salt = batch.column(batch.schema.get_field_index("salt")).to_numpy().view(np.uint64)
    return row, _mix(_mix(flat + nth.astype(np.uint64)) ^ salt[row])


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(40)).astype(np.int64) % SLOTS


def _counts(hashed: DataFrame) -> np.ndarray:
    """How many tokens each slot has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in _pieces(batches):
            n += np.bincount(_slot(_tokens(batch)[1]), minlength=SLOTS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["slot", "n"])

    found = hashed.select("salt", "hashes").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def _postings(hashed: DataFrame, share: float) -> DataFrame:
    """(session_id, ord, n, rank, token): the rarest tokens of each text, enough that two texts that share n * share of n tokens have one of them in common."""
    counts = hashed.sparkSession.sparkContext.broadcast(_counts(hashed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            row, tokens = _tokens(batch)
            common = counts.value[_slot(tokens)]
            n = np.bincount(row, minlength=len(batch))
            order = np.concatenate([hi - k + np.lexsort((tokens[hi - k : hi], common[hi - k : hi])) for k, hi in zip(n, np.cumsum(n), strict=True)])
            rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            take = rank < (n - np.ceil(n * share - 1e-9) + 1)[row]
            at = pa.array(row[take])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)).take(at) for c in KEY], pa.array(n[row[take]].astype(np.int32)), pa.array(rank[take].astype(np.int32)), pa.array(tokens[order][take].view(np.int64))], [*KEY, "n", "rank", "token"])

    kind = hashed.schema["ord"].dataType.simpleString()
    return hashed.drop("digest").mapInArrow(run, f"session_id string, ord {kind}, n int, rank int, token long")


def _sketches(hashed: DataFrame, width: float) -> DataFrame:
    """(session_id, ord, n, class, digest, bits, counts), by which texts that are not similar are told apart.

    class: the logarithm of n. bits: which remainders of BITS an odd number of a text's tokens have. counts: of a long
    text how many tokens each remainder has, 255 at most, of half to a quarter as many remainders as lines. Two texts
    differ in as many tokens at least as in bits, and as their counts differ by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            row, tokens = _tokens(batch)
            n = np.bincount(row, minlength=len(batch))
            odd = np.bincount(row * BITS + (tokens % np.uint64(BITS)).astype(np.int64), minlength=len(batch) * BITS).reshape(-1, BITS) & 1
            bits = [x.tobytes() for x in np.packbits(odd.astype(bool), axis=1)]
            counts, high = [b""] * len(batch), (tokens >> np.uint64(32)).astype(np.int64)
            for k, hi in enumerate(np.cumsum(n)):
                if n[k] >= LONG:
                    size = 1 << int(n[k] // 2).bit_length() - 1
                    counts[k] = np.minimum(np.bincount(high[hi - n[k] : hi] & (size - 1), minlength=size), 255).astype(np.uint8).tobytes()
            told = [pa.array(n.astype(np.int32)), pa.array((np.log(n) / width).astype(np.int32)), batch.column(batch.schema.get_field_index("digest")), pa.array(bits, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in KEY], *told], [*KEY, "n", "class", "digest", "bits", "counts"])

    kind = hashed.schema["ord"].dataType.simpleString()
    return hashed.mapInArrow(run, f"session_id string, ord {kind}, n int, class int, digest binary, bits binary, counts binary")


def _dealt(sketches: DataFrame) -> DataFrame:
    """Each text in the cells of its block with every block of its class and of those beside it; side is 2 where a block meets itself."""
    beside = Window.partitionBy("session_id").orderBy("class")
    q = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    near = lambda f, d: F.when(f("class").over(beside) == F.col("class") + d, f("q").over(beside)).otherwise(0)
    sizes = sketches.groupBy("session_id", "class").agg(q.alias("q")).select("session_id", "class", "q", near(F.lag, -1).alias("below"), near(F.lead, 1).alias("above"))
    b, c = F.pmod(F.xxhash64(*KEY), F.col("q")).cast("int"), F.col("class")

    def cells(n: str, token, side) -> Column:
        blocks = F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(blocks, lambda o: F.struct(F.xxhash64("session_id", *token(o)).alias("token"), side(o).cast("int").alias("side")))

    same = cells("q", lambda o: (c, F.lit(0), F.least(b, o), F.greatest(b, o)), lambda o: F.when(o == b, 2).when(o < b, 1).otherwise(0))
    above = cells("above", lambda o: (c, F.lit(1), b, o), lambda o: F.lit(0))
    below = cells("below", lambda o: (c - 1, F.lit(1), o, b), lambda o: F.lit(1))
    return sketches.join(sizes, ["session_id", "class"]).withColumn("cell", F.explode(F.concat(same, above, below))).select(*KEY, "n", "digest", "bits", "counts", "first", "cell.token", "cell.side")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by token, whole tokens at a time, and where each token starts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        t = batch.column(batch.schema.get_field_index("token")).to_numpy()
        last = int(np.searchsorted(t, t[-1]))
        if held and held[-1].column(held[-1].schema.get_field_index("token"))[0].as_py() == t[-1]:
            held.append(batch)
            continue
        # What is held ends where the last token of this batch starts.
        held.append(batch.slice(0, last))
        if any(map(len, held)):
            yield _starts(held)
        held = [batch.slice(last)]
    if held:
        yield _starts(held)


def _starts(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    token = t.column("token").to_numpy()
    return t, np.flatnonzero(np.r_[True, token[1:] != token[:-1]] if len(token) else np.zeros(0, bool))


def _folded(counts: list[bytes]) -> np.ndarray:
    """Counts by as few remainders as the least text has."""
    least = min(map(len, counts))
    wide = [np.frombuffer(x, np.uint8) for x in counts]
    return np.stack([x if len(x) == least else np.minimum(x.reshape(-1, least).sum(axis=0), 255).astype(np.uint8) for x in wide])


def _candidates(hashed: DataFrame, threshold: float, limit: int | None) -> DataFrame:
    """(session_id, ord, cand, cell) of texts and earlier ones that share one of their rarest lines and can be similar.

    With a limit, the later one has so many lines at most, and of equal texts the first alone is a candidate, but for
    lines that few texts share. Pairs of one cell are of the same few texts.
    """
    share = threshold / (2 - threshold)
    kind = hashed.schema["ord"].dataType.simpleString()
    most = limit if limit is not None else ANY
    # Texts that fit each other are of one class or of classes side by side.
    width = -np.log(share * 0.99)

    def fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (np.minimum(n, m) >= np.maximum(n, m) * share - 1e-9) & (n <= most)

    def pairs(t: pa.Table, x: np.ndarray, y: np.ndarray) -> list[pa.Array]:
        ords = t.column("ord").combine_chunks()
        return [t.column("session_id").combine_chunks().take(pa.array(x)), ords.take(pa.array(x)), ords.take(pa.array(y))]

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _runs(batches):
            n, rank = t.column("n").to_numpy(), t.column("rank").to_numpy()
            size = np.diff(np.r_[starts, len(n)])
            run, long = np.repeat(np.arange(len(starts)), size), np.repeat(size > FEW, size)
            found = [np.zeros((2, 0), np.int64)]
            for d in range(1, min(FEW, len(n))):
                x = np.flatnonzero((run[d:] == run[:-d]) & ~long[d:]) + d
                found.append(np.stack([x, x - d])[:, fits(n[x], n[x - d])])
            x, y = np.concatenate(found, axis=1)
            # By the first token that two texts share they have no more in common than what follows in either.
            keep = 2 * np.minimum(n[x] - rank[x], n[y] - rank[y]) >= threshold * (n[x] + n[y]) - 1e-9
            x, y = x[keep], y[keep]
            if len(x):
                yield pa.RecordBatch.from_arrays(pairs(t, x, y), [*KEY, "cand"])
            at = pa.array(np.flatnonzero(long))
            if len(at):
                ords = t.column("ord").combine_chunks().take(at)
                yield pa.RecordBatch.from_arrays([t.column("session_id").combine_chunks().take(at), ords, pa.nulls(len(at), ords.type)], [*KEY, "cand"])

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _runs(batches):
            n, token = t.column("n").to_numpy().astype(np.int64), t.column("token").to_numpy()
            side, first = t.column("side").to_numpy(), t.column("first").combine_chunks().to_numpy(zero_copy_only=False)
            bits, digest = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint64).reshape(len(n), -1) for c in ("bits", "digest"))
            for lo, hi in zip(starts, np.r_[starts[1:], len(n)], strict=True):
                own = side[lo] == 2
                old, new = (np.arange(lo, hi),) * 2 if own else (np.flatnonzero(side[lo:hi] == k) + lo for k in (0, 1))
                counts = _folded(t.column("counts").slice(lo, hi - lo).to_pylist()) if n[lo:hi].min() >= LONG else None
                words = np.ascontiguousarray(bits[lo:hi].T)
                for a in range(0, len(new), 128):
                    x = new[a : a + 128]
                    y = old[: a + len(x)] if own else old
                    apart = np.zeros((len(x), len(y)), np.uint16)
                    for w in words:
                        apart += np.bitwise_count(w[x - lo][:, None] ^ w[y - lo])
                    sizes = n[x][:, None] + n[y]
                    i, j = np.nonzero((apart <= (1 - threshold) * sizes + 1e-9) & (np.minimum(n[x][:, None], n[y]) * (1 + share) >= sizes * share - 1e-6))
                    x, y = np.maximum(x[i], y[j]), np.minimum(x[i], y[j])  # in order of ord
                    keep = (x > y) & first[y] & fits(n[x], n[y]) & (digest[x] != digest[y]).any(axis=1)
                    if own:
                        keep &= new[a + i] > old[j]
                    x, y = x[keep], y[keep]
                    if counts is not None and len(x):
                        step = max(1, (1 << 22) // counts.shape[1])
                        apart = np.concatenate([(np.maximum(u, v) - np.minimum(u, v)).sum(axis=1, dtype=np.uint32) for k in range(0, len(x), step) for u, v in [(counts[x[k : k + step] - lo], counts[y[k : k + step] - lo])]])
                        keep = apart <= (1 - threshold) * (n[x] + n[y]) + 1e-9
                        x, y = x[keep], y[keep]
                    if len(x):
                        part = digest[x, 0] % np.uint64(SPLIT) * np.uint64(SPLIT) + digest[y, 0] % np.uint64(SPLIT)
                        cell = _mix(token[lo : lo + 1].view(np.uint64) + part)
                        yield pa.RecordBatch.from_arrays([*pairs(t, x, y), pa.array(cell.view(np.int64))], [*KEY, "cand", "cell"])

    postings = _postings(hashed, share).repartition("token").sortWithinPartitions("token", "ord")
    met = cut(postings.mapInArrow(few, f"session_id string, ord {kind}, cand {kind}").distinct(), "line-meetings")
    pairs_met = met.where("cand < ord")
    partners = pairs_met.select("session_id", F.explode(F.array("ord", "cand")).alias("ord")).groupBy(*KEY).count().where(F.col("count") > PARTNERS)
    blocks = met.where("cand is null").select(*KEY).unionByName(partners.select(*KEY)).distinct()
    told = cut(blocks.join(_sketches(hashed, width), KEY), "line-sketches")
    both = [told.select("session_id", F.col("ord").alias(c), F.lit(True).alias(f"{c}_told")) for c in ("ord", "cand")]
    alone = pairs_met.join(both[0], KEY, "left").join(both[1], ["session_id", "cand"], "left").where("not coalesce(ord_told and cand_told, false)")
    alone = alone.select(*KEY, "cand", F.xxhash64("session_id", "cand").alias("cell"))
    if limit is None:
        told = told.withColumn("first", F.lit(True))
    else:
        first = told.groupBy("session_id", "digest").agg(F.min("ord").alias("ord")).select(*KEY, F.lit(True).alias("first"))
        told = told.join(first, KEY, "left").withColumn("first", F.coalesce("first", F.lit(False)))
    more = _dealt(told).repartition("token").sortWithinPartitions("token", "ord").mapInArrow(many, f"session_id string, ord {kind}, cand {kind}, cell long")
    return alone.unionByName(more)


def _pairs(corpus: DataFrame, threshold: float, limit: int | None = None) -> DataFrame:
    """(session_id, ord, cand, cell): all texts and earlier ones that may have a similarity of `threshold`, written."""
    if threshold <= 0:
        pairs = corpus.select(*KEY).join(corpus.select("session_id", F.col("ord").alias("cand")), "session_id").where("cand < ord")
        pairs = pairs.withColumn("cell", F.xxhash64("session_id", "cand"))
    else:
        hashed = corpus.select(*KEY, F.xxhash64("session_id").alias("salt"), F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)).alias("hashes"), F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("digest"))
        pairs = _candidates(hashed, threshold, limit)
    return cut(pairs, "line-pairs")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs with either's text, and with the candidate's other columns."""
    old = texts.select("session_id", F.col("ord").alias("cand"), F.col("text").alias("old"), *[c for c in texts.columns if c not in (*KEY, "text")])
    return pairs.join(old, ["session_id", "cand"]).join(texts.select(*KEY, "text"), KEY)


def similar_pairs(corpus: DataFrame, threshold: float) -> DataFrame:
    """(session_id, ord, cand, sim) of all texts and earlier ones with a similarity of `threshold` or more, unless they are equal.

    corpus: (session_id, ord, text), ord being any type that sorts. Similarity is twice the common lines by the lines of
    both. Candidates share one of their rarest lines: of n lines a pair must share at least n * t / (2 - t), so that it
    meets in the n - that + 1 rarest of either. Common lines such as blank ones thus hardly ever join. Which lines are
    rare is told by counters, which do not grow with the lines.
    """
    kind = corpus.schema["ord"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = np.array([-1.0 if a == b else bag_similarity(a.split("\n"), b.split("\n")) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)], np.float64)
            keep = pa.array(sims >= max(threshold, 0.0))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).filter(keep) for k in range(3)], pa.array(sims).filter(keep)], [*KEY, "cand", "sim"])

    both = _with_texts(_pairs(corpus, threshold), corpus.select(*KEY, "text")).select(*KEY, "cand", "old", "text")
    return both.mapInArrow(run, f"session_id string, ord {kind}, cand {kind}, sim double")


def best_candidates(corpus: DataFrame, threshold: float) -> DataFrame:
    """(session_id, ord, cand, sim): of the earlier texts the most similar, of several the earliest."""
    first = Window.partitionBy(*KEY).orderBy(F.col("sim").desc(), "cand")
    return similar_pairs(corpus, threshold).withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def _plain(x):
    return tuple(x.values()) if isinstance(x, dict) else x


def _coded(texts: list[str]) -> tuple[list[np.ndarray], int]:
    """The lines of each text as numbers, one for each line and count of its occurrence, so that sets agree where bags do; how many numbers."""
    codes: dict[tuple[str, int], int] = {}
    out = []
    for text in texts:
        seen: dict[str, int] = {}
        row = []
        for line in text.split("\n"):
            seen[line] = k = seen.get(line, 0) + 1
            row.append(codes.setdefault((line, k), len(codes)))
        out.append(np.array(row, np.int32))
    return out, len(codes)


def _bests(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(session_id, ord, cand, sim): of the candidates the most similar, of several the earliest. Each text goes once to a cell, however many pairs it has there."""
    kind = texts.schema["ord"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _runs(batches):
            for lo, hi in zip(starts, np.r_[starts[1:], len(t)], strict=True):
                cell = t.slice(lo, hi - lo)
                session, ords, cands, told = (cell.column(c).to_pylist() for c in (*KEY, "cand", "text"))
                own = [k for k, x in enumerate(told) if x is not None]
                at = {(session[k], _plain(ords[k])): i for i, k in enumerate(own)}
                text = [told[k] for k in own]
                codes, n = _coded(text)
                new: dict[int, list[int]] = {}
                for k, x in enumerate(told):
                    if x is None:
                        new.setdefault(at[session[k], _plain(ords[k])], []).append(k)
                marked, found = np.zeros(n, bool), []
                for x, rows in new.items():
                    marked[codes[x]] = True
                    best = None
                    for k in rows:
                        y = at[session[k], _plain(cands[k])]
                        sim = 2 * int(np.count_nonzero(marked[codes[y]])) / (len(codes[x]) + len(codes[y]))
                        if sim >= max(threshold, 0.0) and text[x] != text[y] and (best is None or (-sim, _plain(cands[k])) < best[:2]):
                            best = -sim, _plain(cands[k]), k
                    marked[codes[x]] = False
                    found += [best] if best else []
                if found:
                    rows = cell.take(pa.array([k for *_, k in found])).combine_chunks()
                    yield pa.RecordBatch.from_arrays([*[rows.column(c).combine_chunks() for c in (*KEY, "cand")], pa.array([-d for d, *_ in found], pa.float64())], [*KEY, "cand", "sim"])

    who = pairs.select("session_id", "cell", F.explode(F.array("ord", "cand")).alias("ord")).distinct()
    sent = who.join(texts.select(*KEY, "text"), KEY).select(F.col("cell").alias("token"), *KEY, F.lit(None).cast(kind).alias("cand"), "text")
    asked = pairs.select(F.col("cell").alias("token"), *KEY, "cand", F.lit(None).cast("string").alias("text"))
    dealt = sent.unionByName(asked).repartition("token").sortWithinPartitions("token")
    bests = dealt.mapInArrow(run, f"session_id string, ord {kind}, cand {kind}, sim double")
    return bests.groupBy(*KEY).agg(F.min(F.struct((-F.col("sim")).alias("d"), "cand")).alias("x")).select(*KEY, "x.cand", (-F.col("x.d")).alias("sim"))


def near_diffs(corpus: DataFrame, options: NearOptions) -> DataFrame:
    """(session_id, ord, ref, sim, diff): the diff against each best candidate, where neither is too long and it is shorter than the text.

    corpus has ref too, the name by which a base is referred to. If a diff may have so many lines at most, texts of so many
    more that no text with a diff is near them are not looked at.
    """
    limit, t = ANY if options.max_diff_lines is None else options.max_diff_lines, options.threshold
    if t > 0 and limit < ANY:
        corpus = corpus.where(F.size(F.split("text", "\n")) <= int(limit * (2 - t) / t + 1e-6))
    corpus = cut(corpus.select(*KEY, "text", "ref"), "near-texts")  # read several times

    def diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shown = [], []
            for k, (old, new) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                old, lines = old.split("\n"), new.split("\n")
                if max(len(old), len(lines)) <= limit:
                    out = render_diff(diff_lines(old, lines))
                    if len(out.encode("utf-8", "replace")) < len(new.encode("utf-8", "replace")):
                        rows.append(k)
                        shown.append(out)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(4)], pa.array(shown, pa.string())], [*KEY, "ref", "sim", "diff"])

    both = _with_texts(_bests(_pairs(corpus, t, limit), corpus, t), corpus).select(*KEY, "ref", "sim", "old", "text")
    return both.mapInArrow(diff, f"session_id string, ord {both.schema['ord'].dataType.simpleString()}, ref string, sim double, diff string")


def _with_diffs(table: DataFrame, eligible: Column, ref: Column, keys: list[str], column: str, what: str, options: NearOptions) -> DataFrame:
    """table with __new, the marker and diff of `column` where there is one. Only rows that may have one are exchanged."""
    rows = table.where(eligible)
    found = near_diffs(rows.select("session_id", F.struct(*keys).alias("ord"), F.col(column).alias("text"), ref.alias("ref")), options)
    head = F.concat(F.lit(f"[near-duplicate of {what} "), F.col("ref"), F.lit(" ("), js_round(F.col("sim") * 100).cast("string"), F.lit("% similar), lossless line diff follows]\n"))
    new = found.select("session_id", *[F.col(f"ord.{k}").alias(k) for k in keys], F.concat(head, F.col("diff")).alias("__new"))
    fits = F.lit(True) if options.max_diff_lines is None else F.size(F.split(column, "\n")) <= options.max_diff_lines
    short = F.coalesce(eligible & fits, F.lit(False))
    return table.where(short).join(new, ["session_id", *keys], "left").unionByName(table.where(~short).withColumn("__new", F.lit(None).cast("string")))


def near_dedupe(t: Transcript, options: NearOptions = NearOptions()) -> Transcript:
    """Text blocks of results, and apart from them string arguments of calls, that are near an earlier one become diffs."""
    block_keys, arg_keys = ["msg_idx", "block_idx"], ["msg_idx", "block_idx", "arg_idx"]
    least_arg = options.min_length if options.min_arg_length is None else options.min_arg_length
    eligible = is_text() & (utf8_len(F.col("text")) >= options.min_length)
    out = _with_diffs(t.blocks, eligible, F.coalesce("tool_call_id", F.lit("undefined")), block_keys, "text", "toolCallId", options)
    grown = F.when(F.col("__new").isNull(), F.lit(0)).otherwise(json_string_len(F.col("__new")) - json_string_len(F.col("text")))
    out = out.withColumns({"json_bytes": F.col("json_bytes") + grown, "text": F.coalesce("__new", "text")}).select(*t.blocks.columns)
    eligible = utf8_len(F.col("arg_value")) >= least_arg
    new_args = _with_diffs(t.call_args, eligible, F.concat_ws(":", "call_id", "arg_key"), arg_keys, "arg_value", "toolCall argument", options).withColumn("arg_value", F.coalesce("__new", "arg_value"))
    return t.with_(blocks=out, call_args=new_args.select(*t.call_args.columns))
