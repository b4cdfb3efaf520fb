"""The passes in their order, with statistics, and the messages that come out."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrollmill.functions.text import json_string_len, utf8_len
from scrollmill.operators.exact import block_dedupe, exact_dedupe
from scrollmill.operators.minify import minify
from scrollmill.operators.neardup import near_dedupe
from scrollmill.operators.reads import referenced, superseded_reads
from scrollmill.operators.runs import runlength
from scrollmill.operators.shingle import shingle_dedupe
from scrollmill.schema import DEFAULTS, Options, Transcript
from scrollmill.storage import cut, tidy

Pass = tuple[str, Callable[[Transcript], Transcript]]
KEY = ["session_id", "msg_idx"]
#: The optional pass.
MINIFY: Pass = ("pass-f-minify", minify)


def passes(t: Transcript, options: Options = DEFAULTS, extra: Sequence[Pass] = ()) -> list[Pass]:
    safe = referenced(t, options.exact) if options.safe_refs else None
    return [
        ("pass-a-dedupe", lambda x: exact_dedupe(x, options.exact)),
        ("pass-b-superseded-reads", lambda x: superseded_reads(x, safe)),
        ("pass-c-runlength", runlength),
        ("pass-d-block-dedup", lambda x: block_dedupe(x, options.block)),
        ("pass-g-shingle-dedup", lambda x: shingle_dedupe(x, options.shingle)),
        ("pass-e-near-dupe", lambda x: near_dedupe(x, options.near)),
        *extra,
    ]


#: Passes that look at a row alone and so join the next pass's plan.
ROW_LOCAL = {"pass-c-runlength", "pass-f-minify"}


def _written(t: Transcript, before: Transcript, name: str) -> Transcript:
    """The tables that a pass has changed, written: the next pass reads its input several times, which must not run this one again."""
    return t.with_(**{c: cut(getattr(t, c), name) for c in ("blocks", "call_args") if getattr(t, c) is not getattr(before, c)})


def _settled(t: Transcript, before: Transcript, name: str) -> Transcript:
    return t if name in ROW_LOCAL else _written(t, before, name)


def compress(t: Transcript, options: Options = DEFAULTS, extra: Sequence[Pass] = ()) -> Transcript:
    """All passes, one after the other; messages are neither removed nor reordered."""
    with tidy(t.messages.sparkSession):
        return reduce(lambda x, p: _settled(p[1](x), x, p[0]), passes(t, options, extra), t)


def _sizes(t: Transcript) -> DataFrame:
    """(session_id, msg_idx, size, digest) of what passes can change: bytes of JSON, apart from what stays, and a digest."""
    row = F.struct(F.lit(0).alias("kind"), "block_idx", F.lit(0).alias("arg_idx"), F.xxhash64("block_type", "text", "data", "mime_type", "src_idx").alias("h"))
    blocks = t.blocks.select(*KEY, (F.col("json_bytes") + 1).alias("size"), row.alias("row"))
    row = F.struct(F.lit(1).alias("kind"), "block_idx", "arg_idx", F.xxhash64("arg_value").alias("h"))
    args = t.call_args.select(*KEY, json_string_len(F.col("arg_value")).alias("size"), row.alias("row"))
    return blocks.unionByName(args).groupBy(*KEY).agg(F.sum("size").alias("size"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("digest"))


def total_bytes(messages: DataFrame) -> DataFrame:
    """(session_id, messages, bytes): bytes of a session's messages as a JSON array."""
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), (2 + F.sum(utf8_len(F.col("raw_json"))) + F.greatest(F.count(F.lit(1)) - 1, F.lit(0))).alias("bytes"))


def with_stats(t: Transcript, options: Options = DEFAULTS, extra: Sequence[Pass] = ()) -> tuple[Transcript, DataFrame]:
    """The compressed transcript, and (session_id, pass_no, pass, bytes_before, bytes_after, hits) for each session and pass.

    Sizes follow from what a pass has changed; hits are the messages whose JSON it has changed.
    """
    with tidy(t.messages.sparkSession):
        outs, stats = traced(t, options, extra)
    return outs[-1], stats


def traced(t: Transcript, options: Options = DEFAULTS, extra: Sequence[Pass] = ()) -> tuple[list[Transcript], DataFrame]:
    """The transcript after each pass, and the statistics of with_stats."""
    whole = total_bytes(t.messages)
    before, rows, out, outs = cut(_sizes(t), "sizes"), [], t, []
    for k, (name, f) in enumerate(passes(t, options, extra)):
        out = _written(f(out), out, name)
        outs.append(out)
        after = cut(_sizes(out), "sizes")  # narrow; the next pass is held against it
        both = before.join(after.select(*KEY, F.col("size").alias("new"), F.col("digest").alias("new_digest")), KEY)
        diff = both.groupBy("session_id").agg(F.sum(F.col("new") - F.col("size")).alias("delta"), F.sum((F.col("digest") != F.col("new_digest")).cast("long")).alias("hits"))
        rows.append(diff.select("session_id", F.lit(k).alias("pass_no"), F.lit(name).alias("pass"), "delta", "hits"))
        before = after
    changes = reduce(DataFrame.unionByName, rows)
    names = t.messages.sparkSession.createDataFrame([(k, n) for k, (n, _) in enumerate(passes(t, options, extra))], "pass_no int, pass string")
    every = whole.crossJoin(F.broadcast(names)).join(changes.drop("pass"), ["session_id", "pass_no"], "left").fillna(0, ["delta", "hits"])
    running = F.sum("delta").over(Window.partitionBy("session_id").orderBy("pass_no"))
    stats = every.select("session_id", "pass_no", "pass", (F.col("bytes") + running - F.col("delta")).alias("bytes_before"), (F.col("bytes") + running).alias("bytes_after"), "hits")
    return outs, cut(stats, "stats")


def _rendered(raw: pd.Series, blocks: pd.Series, args: pd.Series) -> pd.Series:
    def one(raw, blocks, args):
        if raw is None:
            return None
        m = json.loads(raw)
        if blocks is not None and len(blocks):
            old = m["content"]
            m["content"] = [{"type": "text", "text": b["text"]} if b["src_idx"] is None or b["src_idx"] != b["src_idx"] else ({**old[int(b["src_idx"])], "text": b["text"]} if b["block_type"] == "text" else old[int(b["src_idx"])]) for b in blocks]
        for a in [] if args is None else args:
            m["content"][int(a["block_idx"])]["arguments"][a["arg_key"]] = a["arg_value"]
        return json.dumps(m, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([one(*row) for row in zip(raw, blocks, args, strict=True)], dtype=object)


def messages_of(t: Transcript, start: Transcript) -> DataFrame:
    """start's messages with the content that t has: only those that have changed are rendered anew."""
    changed = _sizes(start).join(_sizes(t).select(*KEY, F.col("digest").alias("new_digest")), KEY).where("digest <> new_digest").select(*KEY)
    blocks = t.blocks.join(changed, KEY).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("block_idx", "src_idx", "block_type", "text"))).alias("blocks"))
    args = t.call_args.join(changed, KEY).groupBy(*KEY).agg(F.collect_list(F.struct("block_idx", "arg_key", "arg_value")).alias("args"))
    joined = start.messages.join(blocks, KEY, "left").join(args, KEY, "left")
    new = F.col("blocks").isNotNull() | F.col("args").isNotNull()
    return joined.withColumn("raw_json", F.when(new, F.pandas_udf(_rendered, "string")(F.when(new, F.col("raw_json")), "blocks", "args")).otherwise(F.col("raw_json"))).drop("blocks", "args")
