"""Queries over transcripts that are built from the shared tables, so that SQL can say what must come out.

The documents of a language are a session. What decides (tools, paths, faults, repeats) follows from doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.functions import blocks as B
from scrollmill.functions.text import utf8_len
from scrollmill.operators.exact import block_dedupe, exact_dedupe
from scrollmill.operators.minify import minify
from scrollmill.operators.neardup import near_dedupe, near_diffs
from scrollmill.operators.reads import superseded_reads
from scrollmill.operators.shingle import shingle_dedupe, shingle_texts
from scrollmill.plans.compress import messages_of, with_stats
from scrollmill.plans.integrity import check_integrity
from scrollmill.plans.report import grand_total, pass_totals, session_rows
from scrollmill.schema import NearOptions, Options, ShingleOptions, Transcript
from scrollmill.sources.sessions import from_json_messages, from_tool_results, read_sessions
from scrollmill.sources.tables import conversation_messages, document_results, tool_results
from scrollmill.storage import shared_dir, write_named

#: Passes G and E find nothing: what SQL cannot say is off.
STRUCTURAL = Options(near=NearOptions(min_length=1 << 30), shingle=ShingleOptions(shingle=1 << 30, min_repeat=1 << 30))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, k, text)"""
    return document_results(spark, folder).select("session_id", F.col("msg_idx").alias("k"), "text")


def _text(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), text.alias("text"))


def _result(call_id: Column, *blocks: Column) -> Column:
    """JSON of a tool result; blocks are JSON."""
    head = F.to_json(F.struct(F.lit("toolResult").alias("role"), call_id.alias("toolCallId")))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"content":['), F.concat_ws(",", *blocks), F.lit("]}"))


def _call(call_id: Column, tool: Column, args: Column) -> Column:
    """JSON of an assistant message with one call; args is a map of strings."""
    block = F.struct(F.lit("toolCall").alias("type"), call_id.alias("id"), tool.alias("name"), args.alias("arguments"))
    return F.to_json(F.struct(F.lit("assistant").alias("role"), F.array(block).alias("content")))


def _said(rows: DataFrame, *messages: Column) -> DataFrame:
    """(session_id, msg_idx, raw_json): the messages of each row (session_id, k), one after the other."""
    n = len(messages)
    return rows.select("session_id", F.posexplode(F.array(*messages)).alias("i", "raw_json"), "k").select("session_id", (F.col("k") * n + F.col("i")).alias("msg_idx"), "raw_json")


def _id(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("k").cast("string"))


def jsonl_messages(spark, folder):
    """Conversations as session files with lines that must be passed over, read back."""
    m = conversation_messages(spark, folder)
    message = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.coalesce("text", F.lit("")).alias("content")).alias("message")))
    kind = F.col("msg_idx") % 4
    junk = F.when(kind == 0, '{"type":"message","message":{').when(kind == 1, '{"type":"other","message":{"role":"user"}}').when(kind == 2, '{"type":"message","message":null}').otherwise("  ")
    lines = m.select("session_id", F.struct("msg_idx", F.concat(message, F.lit("\n"), junk).alias("line")).alias("x"))
    files = lines.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("value"))
    path = write_named(files.select(F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("name"), "value"), f"{shared_dir(spark)}/sessions", ".jsonl")
    out = read_sessions(spark, path).messages
    return out.select("session_id", "msg_idx", "role", "content_is_array", utf8_len(F.get_json_object("raw_json", "$.content")).alias("n_bytes"))


#: Tools by k % 9, and what they do.
TOOLS = ["edit", "write", "write_file", "create_file", "read", "read_file", "view", "bash", "ipython"]


def _file_calls(spark, folder) -> Transcript:
    """A call and its result for each document, on one of eleven paths; the last tool reads one path and writes another."""
    k = F.col("k") % 9
    path, other = (F.concat(F.lit("/f/"), (x % 11).cast("string")) for x in (F.col("k"), F.col("k") + 4))
    tool = F.get(F.array(*map(F.lit, TOOLS)), k.cast("int"))
    key = F.when(k == 7, "command").when(k == 8, "code").otherwise("path")
    code = F.concat(F.lit("open('"), path, F.lit("').read()\nopen('"), other, F.lit("', 'w')"))
    value = F.when(k == 7, F.concat(F.lit("cat "), path)).when(k == 8, code).otherwise(path)
    rows = _docs(spark, folder)
    return from_json_messages(_said(rows, _call(_id("c-"), tool, F.create_map(key, value)), _result(_id("c-"), F.to_json(_text(F.col("text"))))))


def stale_read_markers(spark, folder):
    """Pass B as a whole."""
    out = superseded_reads(_file_calls(spark, folder))
    return out.blocks.select("session_id", "msg_idx", "tool_call_id", "text")


def stale_read_messages(spark, folder):
    """The messages that pass B changes, rendered anew."""
    t = _file_calls(spark, folder)
    return messages_of(superseded_reads(t), t).where("role = 'toolResult'").select("session_id", "msg_idx", "role", "raw_json")


def _blocks(spark, folder) -> Transcript:
    """Results of a text, one of twenty images and one of three notes."""
    image = F.struct(F.lit("image").alias("type"), F.repeat(F.md5((F.col("k") % 20).cast("string")), 10).alias("data"), F.lit("image/png").alias("mimeType"))
    note = _text(F.concat(F.lit("note "), F.repeat((F.col("k") % 3).cast("string"), 250)))
    return from_json_messages(_said(_docs(spark, folder), _result(_id("doc-"), F.to_json(_text(F.col("text"))), F.to_json(image), F.to_json(note))))


def multi_block_fingerprint(spark, folder):
    whole = B.per_message(_blocks(spark, folder).blocks)
    return whole.select("session_id", "msg_idx", "tool_call_id", F.sha2("fingerprint", 256).alias("fingerprint"), F.sha2("shown", 256).alias("shown"), "bytes", "json_bytes")


def multi_block_dedupe(spark, folder):
    """Pass D over images and repeats beside other blocks."""
    out = block_dedupe(_blocks(spark, folder)).blocks
    return out.select("session_id", "msg_idx", "block_idx", "block_type", F.coalesce("text", "data").alias("content"))


def deduped_messages(spark, folder):
    """Messages after pass A."""
    t = tool_results(spark, folder)
    return messages_of(exact_dedupe(t), t).select("session_id", "msg_idx", "role", "raw_json")


def minified(spark, folder):
    """Pass F on results that are JSON with blanks around."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    text = F.concat(F.lit("  "), F.col("props"), F.lit(" \t\n\n\n\n\n"))
    rows = events.select(F.lit("all").alias("session_id"), F.col("event_id").cast("int").alias("msg_idx"), F.col("event_id").cast("string").alias("tool_call_id"), text.alias("text"))
    return minify(from_tool_results(rows)).blocks.select("msg_idx", "text")


def _appended(spark, folder) -> tuple[Column, Column, DataFrame]:
    """Texts with a word a line, each line its document's own, and the same with a line more."""
    line = F.transform(F.split("text", " "), lambda w: F.concat(F.col("k").cast("string"), F.lit(":"), F.replace(w, F.lit("\n"), F.lit(" "))))
    old = F.array_join(line, "\n")
    return old, F.concat(old, F.lit("\nadded "), F.col("k").cast("string")), _docs(spark, folder)


def near_append_diffs(spark, folder):
    old, new, docs = _appended(spark, folder)
    rows = docs.select("session_id", "k", F.posexplode(F.array(old, new)).alias("i", "text"))
    corpus = rows.where(utf8_len(F.col("text")) >= 200).select("session_id", (F.col("k") * 2 + F.col("i")).alias("ord"), "text", F.concat(F.lit("r-"), (F.col("k") * 2 + F.col("i")).cast("string")).alias("ref"))
    return near_diffs(corpus, NearOptions())


def near_append_arguments(spark, folder):
    """Pass E on arguments under different keys."""
    old, new, docs = _appended(spark, folder)
    t = from_json_messages(_said(docs, _call(_id("a-"), F.lit("ipython"), F.create_map(F.lit("code"), old)), _call(_id("b-"), F.lit("bash"), F.create_map(F.lit("command"), new))))
    return near_dedupe(t).call_args.select("session_id", "msg_idx", "call_id", "arg_key", F.sha2("arg_value", 256).alias("arg_value"))


def near_append_results(spark, folder):
    """Pass E on results."""
    old, new, docs = _appended(spark, folder)
    t = from_json_messages(_said(docs, _result(_id("a-"), F.to_json(_text(old))), _result(_id("b-"), F.to_json(_text(new)))))
    return near_dedupe(t).blocks.select("session_id", "msg_idx", "tool_call_id", F.sha2("text", 256).alias("text"), "json_bytes")


def _banners(spark, folder) -> DataFrame:
    """(session_id, msg_idx, block_idx, text, ref, protected): of each document two texts with a banner of its own in common, whose first characters share a code unit."""
    d = _docs(spark, folder).select("session_id", "k", F.md5(F.concat(F.col("session_id"), F.lit("/"), F.col("k").cast("string"))).alias("h"))
    banner = F.concat(*[F.md5(F.concat(F.col("h"), F.lit(str(i)))) for i in range(6)])
    first, second = F.concat(F.lit("first \U0001f600"), banner, F.lit(" end")), F.concat(F.lit("second "), F.reverse("h"), F.lit("\U0001fa00"), banner, F.lit("; done"))
    rows = d.select("session_id", "k", F.posexplode(F.array(first, second)).alias("i", "text"))
    return rows.select("session_id", (F.col("k") * 2 + F.col("i")).alias("msg_idx"), F.lit(0).alias("block_idx"), "text", F.concat(F.lit("r-"), F.col("k").cast("string")).alias("ref"), ((F.col("i") == 1) & (F.col("k") % 5 == 0)).alias("protected"))


def shingle_banners(spark, folder):
    """Pass G where the repeats are known; protected texts stay."""
    return shingle_texts(_banners(spark, folder), ShingleOptions()).select("session_id", "msg_idx", "new_text", F.size("spans").alias("n_spans"))


def shingle_banners_recent(spark, folder):
    """Pass G over a transcript, the last 40 messages of each session protected."""
    rows = _banners(spark, folder).select("session_id", "msg_idx", F.col("ref").alias("tool_call_id"), "text")
    nth = rows.withColumn("msg_idx", F.expr("cast(row_number() over (partition by session_id order by msg_idx) - 1 as int)"))
    return shingle_dedupe(from_tool_results(nth), ShingleOptions(recent_window=40)).blocks.select("session_id", "msg_idx", "text", "json_bytes")


def structural_stats(spark, folder):
    """Statistics over the passes that SQL can express."""
    return with_stats(tool_results(spark, folder), STRUCTURAL)[1]


def structural_passes(spark, folder):
    return pass_totals(structural_stats(spark, folder))


def structural_sessions(spark, folder):
    """The session report, checked against the messages that come out: results here have no calls, and no session is all right."""
    t = tool_results(spark, folder)
    out, stats = with_stats(t, STRUCTURAL)
    return session_rows(stats, t.messages, check_integrity(t.messages, messages_of(out, t)))


def structural_total(spark, folder):
    t = tool_results(spark, folder)
    stats = with_stats(t, STRUCTURAL)[1]
    return grand_total(session_rows(stats, t.messages, t.messages.select("session_id").limit(0)))


def _paired(spark, folder) -> DataFrame:
    """Messages (session_id, msg_idx, role, tool_call_id, raw_json): a call and its result for each document."""
    call = _call(_id("c-"), F.lit("ipython"), F.create_map(F.lit("code"), F.lit("1")))
    return from_json_messages(_said(_docs(spark, folder), call, _result(_id("c-"), F.to_json(_text(F.col("text")))))).messages


def integrity_of_compressed(spark, folder):
    """What is wrong after all passes that SQL can express: nothing."""
    t = _file_calls(spark, folder)
    out, _ = with_stats(t, STRUCTURAL)
    return check_integrity(t.messages, messages_of(out, t)).groupBy("session_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def integrity_faults(spark, folder):
    """Each rule, on faults planted by document: a result that is missing (1), a call that is no JSON (2), another role (3), another id (4), a call more (5)."""
    before = _paired(spark, folder)
    k = F.floor(F.col("msg_idx") / 2).cast("int")
    fault, is_call = k % 50, F.col("msg_idx") % 2 == 0
    name = F.concat(F.lit("c-"), k.cast("string"))
    one_more = F.concat(F.regexp_replace("raw_json", r"\]\}$", ""), F.lit(',{"type":"toolCall","id":"x-'), k.cast("string"), F.lit('","name":"ipython","arguments":{}}]}'))
    raw = F.when(is_call & (fault == 2), F.lit('{"role":"assistant"')).when(is_call & (fault == 4), F.replace(F.col("raw_json"), name, F.concat(F.lit("n-"), k.cast("string")))).when(is_call & (fault == 5), one_more)
    role = F.when(~is_call & (fault == 3), "user").otherwise(F.col("role"))
    after = before.where(is_call | (fault != 1)).withColumns({"raw_json": F.coalesce(raw, F.col("raw_json")), "role": role})
    return check_integrity(before, after).groupBy("session_id", "rule").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        jsonl_messages, stale_read_markers, stale_read_messages, multi_block_fingerprint, multi_block_dedupe, deduped_messages, minified, near_append_diffs, near_append_arguments, near_append_results,
        shingle_banners, shingle_banners_recent, structural_stats, structural_passes, structural_sessions, structural_total, integrity_of_compressed, integrity_faults,
    )
}

_DOCS = "WITH d AS (SELECT lang AS session_id, CAST(doc_id AS INT) AS k, text FROM documents)"
_LEN = "(strlen(T) + len(T) - len(translate(T, '\"\\' || chr(8) || chr(12) || chr(10) || chr(13) || chr(9), '')))"


def _len(text: str) -> str:
    """SQL for the bytes of a text as a JSON string without its quotes."""
    return _LEN.replace("T", text)


_STALE = (
    _DOCS
    + """, o AS (SELECT session_id, k, 2 * k + 1 AS idx, text, '/f/' || (k % 11) AS path, '/f/' || ((k + 4) % 11) AS other FROM d),
e AS (SELECT session_id, idx, path, k % 9 >= 4 AS is_read FROM o UNION ALL SELECT session_id, idx, other, false FROM o WHERE k % 9 = 8),
s AS (SELECT *, max(CASE WHEN is_read THEN idx END) OVER (PARTITION BY session_id, path) AS last_read,
      min(CASE WHEN NOT is_read THEN idx END) OVER (PARTITION BY session_id, path ORDER BY idx RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_write FROM e),
x AS (SELECT DISTINCT session_id, idx FROM s WHERE is_read AND idx <> last_read AND next_write < last_read),
m AS (SELECT o.session_id, o.idx AS msg_idx, 'c-' || k AS tool_call_id, x.idx IS NOT NULL AS stale,
      CASE WHEN x.idx IS NULL THEN text ELSE '[stale: ' || CASE WHEN k % 9 = 8 THEN 'file' ELSE 'file (' || path || ')' END || ' was modified after this read, see later read for current content — ' || len(text) || ' chars elided]' END AS text
      FROM o LEFT JOIN x ON o.session_id = x.session_id AND o.idx = x.idx)"""
)
_RAW = """'{"role":"toolResult","toolCallId":"' || tool_call_id || '","content":[{"type":"text","text":' || CAST(to_json(text) AS VARCHAR) || '}]}'"""
_MULTI = (
    _DOCS
    + """, b AS (SELECT session_id, k AS msg_idx, 'doc-' || k AS tool_call_id, 0 AS block_idx, 'text' AS block_type, text AS content FROM d
UNION ALL SELECT session_id, k, 'doc-' || k, 1, 'image', repeat(md5(CAST(k % 20 AS VARCHAR)), 10) FROM d
UNION ALL SELECT session_id, k, 'doc-' || k, 2, 'text', 'note ' || repeat(CAST(k % 3 AS VARCHAR), 250) FROM d)"""
)
_APPENDED = (
    _DOCS
    + """, w AS (SELECT session_id, k, list_transform(string_split(text, ' '), lambda x: k || ':' || replace(x, chr(10), ' ')) AS ls FROM d),
t AS (SELECT session_id, k, ls, len(ls) AS n, array_to_string(ls, chr(10)) AS old, array_to_string(ls, chr(10)) || chr(10) || 'added ' || k AS new FROM w),
f AS (SELECT *, 2 * CAST(n AS DOUBLE) / (2 * n + 1) AS sim,
      array_to_string(list_transform(CASE WHEN n > 4 THEN ls[:2] ELSE ls END, lambda x: '  ' || x), chr(10))
      || CASE WHEN n > 4 THEN chr(10) || '  ... (' || (n - 4) || ' unchanged lines elided) ...' || chr(10) || '  ' || ls[n - 1] || chr(10) || '  ' || ls[n] ELSE '' END || chr(10) || '+ added ' || k AS diff FROM t),
g AS (SELECT *, strlen(old) >= 200 AND n + 1 <= 400 AND sim >= CAST(0.85 AS DOUBLE) AND strlen(diff) < strlen(new) AS near FROM f)"""
)
_HEAD = "' (' || CAST(floor(sim * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) || '% similar), lossless line diff follows]' || chr(10) || diff"
_BANNERS = (
    _DOCS
    + """, h AS (SELECT session_id, k, md5(session_id || '/' || k) AS h FROM d),
b AS (SELECT *, md5(h || '0') || md5(h || '1') || md5(h || '2') || md5(h || '3') || md5(h || '4') || md5(h || '5') AS banner FROM h),
c AS (SELECT *, 'second ' || reverse(h) || chr(129536) AS head, '[repeated substring, 192 bytes, see earlier occurrence in toolCallId r-' || k || ']' AS marker FROM b)"""
)
_ISLANDS = """SELECT session_id, msg_idx, string_agg(CASE WHEN n >= 3 THEN line || ' (×' || n || ')' ELSE line || repeat(chr(10) || line, CAST(n - 1 AS INT)) END, chr(10) ORDER BY start) AS text_c
FROM (SELECT session_id, msg_idx, island, min(j) AS start, count(*) AS n, any_value(line) AS line FROM
  (SELECT *, sum(new) OVER (PARTITION BY session_id, msg_idx ORDER BY j) AS island FROM
    (SELECT *, CASE WHEN line IS DISTINCT FROM lag(line) OVER (PARTITION BY session_id, msg_idx ORDER BY j) THEN 1 ELSE 0 END AS new FROM
      (SELECT session_id, msg_idx, generate_subscripts(string_split(text_a, chr(10)), 1) AS j, unnest(string_split(text_a, chr(10))) AS line FROM a))) GROUP BY session_id, msg_idx, island) GROUP BY session_id, msg_idx"""
_STATS = (
    _DOCS
    + f""", a0 AS (SELECT session_id, k AS msg_idx, 'doc-' || k AS id, text, strlen(text) AS n, row_number() OVER w AS nth, first_value('doc-' || k) OVER w AS first_id FROM d WINDOW w AS (PARTITION BY session_id, text ORDER BY k)),
a AS (SELECT session_id, msg_idx, id, text, CASE WHEN n >= 40 AND nth > 1 THEN '[identical to output of toolCallId ' || first_id || ', ' || n || ' bytes elided]' ELSE text END AS text_a FROM a0),
c AS ({_ISLANDS}),
e0 AS (SELECT a.*, text_c, row_number() OVER w AS nth, first_value(id) OVER w AS first_id FROM a JOIN c ON a.session_id = c.session_id AND a.msg_idx = c.msg_idx WINDOW w AS (PARTITION BY a.session_id, text_c ORDER BY a.msg_idx)),
e AS (SELECT *, CASE WHEN strlen(text_c) >= 200 AND nth > 1 THEN '[identical text block to output of toolCallId ' || first_id || ', ' || strlen(text_c) || ' bytes elided]' ELSE text_c END AS text_d FROM e0),
z AS (SELECT session_id, count(*) AS messages, CAST(2 + count(*) - 1 + sum(len('{{"role":"toolResult","toolCallId":"","content":[{{"type":"text","text":""}}]}}') + strlen(id) + {_len("text")}) AS BIGINT) AS whole,
      CAST(sum({_len("text_a")} - {_len("text")}) AS BIGINT) AS da, CAST(sum({_len("text_c")} - {_len("text_a")}) AS BIGINT) AS dc, CAST(sum({_len("text_d")} - {_len("text_c")}) AS BIGINT) AS dd,
      count(*) FILTER (text_a <> text) AS ha, count(*) FILTER (text_c <> text_a) AS hc, count(*) FILTER (text_d <> text_c) AS hd FROM e GROUP BY session_id),
p AS (SELECT session_id, messages, whole, unnest([0, 1, 2, 3, 4, 5]) AS pass_no, unnest(['pass-a-dedupe', 'pass-b-superseded-reads', 'pass-c-runlength', 'pass-d-block-dedup', 'pass-g-shingle-dedup', 'pass-e-near-dupe']) AS pass,
      unnest([da, 0, dc, dd, 0, 0]) AS delta, unnest([ha, 0, hc, hd, 0, 0]) AS hits FROM z),
q AS (SELECT *, CAST(whole + sum(delta) OVER (PARTITION BY session_id ORDER BY pass_no) AS BIGINT) AS bytes_after FROM p),
stats AS (SELECT session_id, messages, CAST(pass_no AS INT) AS pass_no, pass, CAST(bytes_after - delta AS BIGINT) AS bytes_before, bytes_after, CAST(hits AS BIGINT) AS hits FROM q)"""
)
_RATIO = "CASE WHEN bytes_before > 0 THEN (1 - CAST(bytes_after AS DOUBLE) / bytes_before) * 100 ELSE 0 END AS ratio"
_TOKENS = ", ".join(f"CAST(floor(bytes_{x} / CAST(4 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS tokens_{x}" for x in ("before", "after"))
_SESSIONS = _STATS + ", r AS (SELECT session_id, any_value(messages) AS messages, min_by(bytes_before, pass_no) AS bytes_before, max_by(bytes_after, pass_no) AS bytes_after FROM stats GROUP BY session_id)"

ORACLES = {
    "jsonl_messages": """SELECT 's' || conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS msg_idx, role, false AS content_is_array, strlen(coalesce(text, '')) AS n_bytes FROM conversations""",
    "stale_read_markers": _STALE + " SELECT session_id, msg_idx, tool_call_id, text FROM m",
    "stale_read_messages": _STALE + f" SELECT session_id, msg_idx, 'toolResult' AS role, {_RAW} AS raw_json FROM m",
    "multi_block_fingerprint": _MULTI
    + f""" SELECT session_id, msg_idx, any_value(tool_call_id) AS tool_call_id,
  sha256(string_agg(CASE block_type WHEN 'text' THEN 'text:' ELSE 'image:image/png:' END || content, chr(10) || chr(0) || chr(10) ORDER BY block_idx)) AS fingerprint,
  sha256(string_agg(CASE block_type WHEN 'text' THEN content ELSE '[image:image/png:' || len(content) || ']' END, chr(10) ORDER BY block_idx)) AS shown,
  CAST(sum(strlen(content)) AS BIGINT) AS bytes,
  CAST(sum(CASE block_type WHEN 'text' THEN 25 ELSE 49 END + {_len("content")}) + 4 AS BIGINT) AS json_bytes FROM b GROUP BY session_id, msg_idx""",
    "multi_block_dedupe": _MULTI
    + """, r AS (SELECT *, row_number() OVER w AS nth, first_value(tool_call_id) OVER w AS first_id FROM b WINDOW w AS (PARTITION BY session_id, block_type, content ORDER BY msg_idx, block_idx))
SELECT session_id, msg_idx, block_idx, CASE WHEN gone THEN 'text' ELSE block_type END AS block_type,
  CASE WHEN gone THEN '[identical ' || block_type || ' block to output of toolCallId ' || first_id || ', ' || strlen(content) || ' bytes elided]' ELSE content END AS content
FROM (SELECT *, nth > 1 AND strlen(content) >= 200 AS gone FROM r)""",
    "deduped_messages": _STATS + f", m AS (SELECT session_id, msg_idx, id AS tool_call_id, text_a AS text FROM a) SELECT session_id, msg_idx, 'toolResult' AS role, {_RAW} AS raw_json FROM m",
    "minified": "SELECT CAST(event_id AS INT) AS msg_idx, CAST(json(props) AS VARCHAR) AS text FROM events",
    "near_append_diffs": _APPENDED + " SELECT session_id, 2 * k + 1 AS ord, 'r-' || (2 * k) AS ref, sim, diff FROM g WHERE near",
    "near_append_arguments": _APPENDED
    + f""" SELECT session_id, 2 * k AS msg_idx, 'a-' || k AS call_id, 'code' AS arg_key, sha256(old) AS arg_value FROM g
UNION ALL SELECT session_id, 2 * k + 1, 'b-' || k, 'command', sha256(CASE WHEN near THEN '[near-duplicate of toolCall argument a-' || k || ':code' || {_HEAD} ELSE new END) FROM g""",
    "near_append_results": _APPENDED
    + f""", m AS (SELECT session_id, 2 * k AS msg_idx, 'a-' || k AS tool_call_id, old AS text FROM g
UNION ALL SELECT session_id, 2 * k + 1, 'b-' || k, CASE WHEN near THEN '[near-duplicate of toolCallId a-' || k || {_HEAD} ELSE new END FROM g)
SELECT session_id, msg_idx, tool_call_id, sha256(text) AS text, 25 + {_len("text")} AS json_bytes FROM m""",
    "shingle_banners": _BANNERS + " SELECT session_id, 2 * k + 1 AS msg_idx, head || marker || '; done' AS new_text, 1 AS n_spans FROM c WHERE k % 5 <> 0",
    "shingle_banners_recent": _BANNERS
    + f""", t AS (SELECT session_id, 2 * k AS m, 'first ' || chr(128512) || banner || ' end' AS text, NULL AS short FROM c UNION ALL SELECT session_id, 2 * k + 1, head || banner || '; done', head || marker || '; done' FROM c),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY m) - 1 AS INT) AS msg_idx, count(*) OVER (PARTITION BY session_id) AS total FROM t),
o AS (SELECT session_id, msg_idx, CASE WHEN msg_idx < total - 40 THEN coalesce(short, text) ELSE text END AS text FROM n)
SELECT session_id, msg_idx, text, 25 + {_len("text")} AS json_bytes FROM o""",
    "structural_stats": _STATS + " SELECT session_id, pass_no, pass, bytes_before, bytes_after, hits FROM stats",
    "structural_passes": _STATS
    + f" SELECT *, {_RATIO} FROM (SELECT pass_no, pass, CAST(sum(bytes_before) AS BIGINT) AS bytes_before, CAST(sum(bytes_after) AS BIGINT) AS bytes_after, CAST(sum(hits) AS BIGINT) AS hits FROM stats GROUP BY pass_no, pass)",
    "structural_sessions": _SESSIONS + f" SELECT session_id, messages, bytes_before, bytes_after, {_RATIO}, {_TOKENS}, false AS ok FROM r",
    "structural_total": _SESSIONS
    + f" SELECT *, {_RATIO}, {_TOKENS} FROM (SELECT count(*) AS sessions, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(bytes_before) AS BIGINT) AS bytes_before, CAST(sum(bytes_after) AS BIGINT) AS bytes_after FROM r)",
    "integrity_of_compressed": _DOCS + " SELECT session_id, 'none' AS rule, CAST(0 AS BIGINT) AS n FROM d WHERE false",
    "integrity_faults": _DOCS
    + """, f AS (SELECT session_id, count(*) FILTER (k % 50 = 1) AS a, count(*) FILTER (k % 50 = 2) AS b, count(*) FILTER (k % 50 = 3) AS c, count(*) FILTER (k % 50 = 4) AS e, count(*) FILTER (k % 50 = 5) AS g FROM d GROUP BY session_id),
r AS (SELECT session_id, unnest(['json', 'message_count', 'role_sequence', 'call_count', 'result_lost', 'call_new', 'result_orphan']) AS rule,
      unnest([b, CAST(a > 0 AS BIGINT), CAST(a + c > 0 AS BIGINT), CAST(b <> g AS BIGINT), a + c, e + g, b + e]) AS n FROM f)
SELECT session_id, rule, CAST(n AS BIGINT) AS n FROM r WHERE n > 0""",
}
