"""Tables, options and presets.

A transcript is four tables. Order is (session_id, msg_idx[, block_idx]); nothing depends on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

MESSAGES = "session_id string, msg_idx int, role string, tool_call_id string, tool_name string, is_error boolean, ts bigint, content_is_array boolean, raw_json string"
#: Blocks of tool results. src_idx is the block's place in raw_json, null for a marker; json_bytes is the size of its JSON.
BLOCKS = "session_id string, msg_idx int, block_idx int, src_idx int, tool_call_id string, block_type string, text string, data string, mime_type string, json_bytes bigint"
CALLS = "session_id string, msg_idx int, block_idx int, call_id string, tool_name string, args_json string"
#: String arguments of tool calls, in the order in which a JavaScript object lists them.
CALL_ARGS = "session_id string, msg_idx int, block_idx int, arg_idx int, call_id string, tool_name string, arg_key string, arg_value string"


@dataclass(frozen=True)
class Transcript:
    messages: DataFrame
    blocks: DataFrame
    calls: DataFrame
    call_args: DataFrame

    def with_(self, **tables: DataFrame) -> Transcript:
        return replace(self, **tables)


@dataclass(frozen=True)
class ExactOptions:
    min_length: int = 40


@dataclass(frozen=True)
class BlockOptions:
    min_block_length: int = 200


@dataclass(frozen=True)
class NearOptions:
    min_length: int = 200
    min_arg_length: int | None = None
    threshold: float = 0.85
    #: Neither text of a diff has more lines; None: they may have any number.
    max_diff_lines: int | None = 400


@dataclass(frozen=True)
class ShingleOptions:
    shingle: int = 64
    min_repeat: int = 64
    recent_window: int = 0


@dataclass(frozen=True)
class Options:
    exact: ExactOptions = field(default_factory=ExactOptions)
    block: BlockOptions = field(default_factory=BlockOptions)
    near: NearOptions = field(default_factory=NearOptions)
    shingle: ShingleOptions = field(default_factory=ShingleOptions)
    #: Keep reads that a duplicate marker refers to from being called stale.
    safe_refs: bool = False


DEFAULTS = Options()
LIVE = Options(near=NearOptions(min_length=512, threshold=0.92), shingle=ShingleOptions(min_repeat=1024, recent_window=6))
