"""The queries over the shared tables and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill import queries_built
from scrollmill.functions import blocks as B
from scrollmill.functions.fileops import bash_ops, file_ops, python_ops
from scrollmill.functions.text import js_trim, json_string_len, token_estimate, utf8_len, utf16_len
from scrollmill.operators.exact import block_dedupe, exact_dedupe, exact_markers
from scrollmill.operators.minify import compact_json
from scrollmill.operators.neardup import best_candidates, near_diffs, similar_pairs
from scrollmill.operators.reads import stale_reads
from scrollmill.operators.runs import collapse_blank, collapse_runs, run_starts, strip_trailing
from scrollmill.operators.shingle import protected_messages, repeated_shingles, shingle_texts
from scrollmill.plans.compress import MINIFY, compress, messages_of, total_bytes, with_stats
from scrollmill.plans.integrity import changed_roles, check_integrity
from scrollmill.plans.report import grand_total, pass_totals, session_rows
from scrollmill.schema import LIVE, NearOptions, Options, ShingleOptions
from scrollmill.sources.tables import conversation_messages, document_results, file_events, tool_results

NEAR = NearOptions(threshold=0.5)


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return document_results(spark, folder)


def tool_result_scan(spark, folder):
    return _docs(spark, folder).select("session_id", "msg_idx", "tool_call_id", utf8_len(F.col("text")).alias("n_bytes"))


def role_counts(spark, folder):
    return conversation_messages(spark, folder).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"))


def byte_lengths(spark, folder):
    return _docs(spark, folder).groupBy("session_id").agg(F.sum(utf8_len(F.col("text"))).alias("n_bytes"), F.max(utf8_len(F.col("text"))).alias("longest"))


def utf16_lengths(spark, folder):
    return _docs(spark, folder).select("session_id", "msg_idx", utf16_len(F.col("text")).alias("units"), utf16_len(F.concat("text", F.lit("😀"))).alias("units_more"))


def token_estimates(spark, folder):
    return _docs(spark, folder).select("session_id", "msg_idx", token_estimate(utf8_len(F.col("text"))).alias("tokens"))


def json_sizes(spark, folder):
    return _docs(spark, folder).select("session_id", "msg_idx", json_string_len(F.col("text")).alias("json_bytes"))


def session_bytes(spark, folder):
    return total_bytes(tool_results(spark, folder).messages)


def content_fingerprint(spark, folder):
    t = tool_results(spark, folder)
    return t.blocks.select("session_id", "msg_idx", F.sha2(B.fingerprint(), 256).alias("fingerprint"), B.n_bytes().alias("n_bytes"), B.shown().alias("shown"))


def exact_dedupe_query(spark, folder):
    out = exact_dedupe(tool_results(spark, folder))
    return out.blocks.select("session_id", "msg_idx", "tool_call_id", "text")


def exact_dedupe_stats(spark, folder):
    t = tool_results(spark, folder)
    joined = exact_markers(t.blocks).join(t.blocks.select("session_id", "msg_idx", "text"), ["session_id", "msg_idx"])
    return joined.groupBy("session_id").agg(F.count(F.lit(1)).alias("hits"), F.sum(utf8_len(F.col("text")) - utf8_len(F.col("marker"))).alias("saved"))


def block_dedupe_query(spark, folder):
    return block_dedupe(tool_results(spark, folder)).blocks.select("session_id", "msg_idx", "block_idx", "text")


def superseded_reads_query(spark, folder):
    return stale_reads(file_events(spark, folder))


def _code(spark, folder):
    d = _docs(spark, folder)
    word = F.regexp_extract("text", "([A-Za-z]+)", 1)
    name = F.concat(F.lit("/tmp/"), F.col("tool_call_id"), F.lit(".txt"))
    k = F.col("msg_idx") % 6
    py = F.concat(
        F.lit("x = "), word, F.when(k == 0, F.concat(F.lit("\nopen('"), name, F.lit("', 'w')"))).when(k == 1, F.concat(F.lit('\nopen( "'), name, F.lit('" )')))
        .when(k == 2, F.concat(F.lit("\nPath('"), name, F.lit("') . read_text()"))).when(k == 3, F.concat(F.lit("\nPath('"), name, F.lit("').write_bytes(x)\nopen('b', 'rb')")))
        .when(k == 4, F.concat(F.lit("\nopen('"), name, F.lit("', 'w+')"))).otherwise("\nopen(name, 'w')"),
    )
    sh = F.concat(
        F.lit("echo "), word, F.when(k == 0, F.concat(F.lit("; cat "), name)).when(k == 1, F.concat(F.lit(" > "), name)).when(k == 2, F.concat(F.lit("\nhead -n 5 "), name, F.lit(" 2>&1")))
        .when(k == 3, F.concat(F.lit(" >> "), name, F.lit(" && tail "), name)).when(k == 4, F.concat(F.lit(" | less -R "), name)).otherwise(" nothing"),
    )
    return d.select("session_id", "msg_idx", py.alias("py"), sh.alias("sh"))


def file_ops_python(spark, folder):
    ops = _code(spark, folder).select("session_id", "msg_idx", F.posexplode(python_ops(F.col("py"))).alias("n", "op"))
    return ops.select("session_id", "msg_idx", "n", "op.path", "op.kind")


def file_ops_bash(spark, folder):
    ops = _code(spark, folder).select("session_id", "msg_idx", F.posexplode(bash_ops(F.col("sh"))).alias("n", "op"))
    return ops.select("session_id", "msg_idx", "n", "op.path", "op.kind")


def file_ops_calls(spark, folder):
    k = F.col("msg_idx") % 5
    tool = F.when(k == 0, "edit").when(k == 1, "read_file").when(k == 2, "bash").when(k == 3, "ipython").otherwise("other")
    key = F.when(k == 2, "command").when(k == 3, "code").otherwise("path")
    value = F.when(k == 2, F.col("sh")).when(k == 3, F.concat(F.lit("%%bash\n"), F.col("sh"))).otherwise(F.concat(F.lit("/p/"), F.col("msg_idx").cast("string")))
    args = F.to_json(F.create_map(key, value))
    ops = _code(spark, folder).select("session_id", "msg_idx", F.explode(file_ops(tool, args)).alias("op"))
    return ops.groupBy("session_id", "op.kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("op.path").alias("paths"))


def runlength_lines(spark, folder):
    return _docs(spark, folder).select("session_id", "msg_idx", collapse_runs(F.col("text")).alias("text"))


def runlength_runs(spark, folder):
    d = _docs(spark, folder).select("session_id", "msg_idx", run_starts(F.split("text", "\n")).alias("at"))
    runs = d.select("session_id", "msg_idx", F.posexplode(F.slice("at", 1, F.size("at") - 1)).alias("k", "start"), "at")
    n = F.get("at", F.col("k") + 1) - F.col("start")
    return runs.select("session_id", "msg_idx", "start", n.alias("n")).where("n >= 3")


def _near_corpus(spark, folder):
    d = _docs(spark, folder).where(utf8_len(F.col("text")) >= NEAR.min_length)
    return d.select("session_id", F.col("msg_idx").alias("ord"), "text", F.col("tool_call_id").alias("ref"))


def line_similarity_pairs(spark, folder):
    return similar_pairs(_near_corpus(spark, folder), NEAR.threshold)


def near_dupe_best(spark, folder):
    return best_candidates(_near_corpus(spark, folder), NEAR.threshold)


def near_dupe_diff(spark, folder):
    """All texts with a word a line: their near copies then have short diffs. The texts may have any number of words."""
    d = _docs(spark, folder).select("session_id", F.col("msg_idx").alias("ord"), F.replace("text", F.lit(" "), F.lit("\n")).alias("text"), F.col("tool_call_id").alias("ref"))
    d = d.where(utf8_len(F.col("text")) >= NearOptions().min_length)
    return near_diffs(d, NearOptions(max_diff_lines=None)).select("session_id", "ord", "ref", "sim", "diff")


def repeated_shingles_query(spark, folder):
    """Shingles at every 64th place alone, as its SQL has it."""
    return repeated_shingles(_docs(spark, folder), 64, 64)


def repeated_shingles_all(spark, folder):
    """Shingles at every place."""
    return repeated_shingles(_docs(spark, folder), 64, 1)


def shingle_dedupe_query(spark, folder):
    texts = _docs(spark, folder).select("session_id", "msg_idx", F.lit(0).alias("block_idx"), "text", F.col("tool_call_id").alias("ref"), F.lit(False).alias("protected"))
    return shingle_texts(texts, ShingleOptions()).select("session_id", "msg_idx", "new_text", F.size("spans").alias("n_spans"))


def _padded(spark, folder):
    return _docs(spark, folder).select("session_id", "msg_idx", F.concat(F.lit("\n\n\n"), F.replace("text", F.lit("\n"), F.lit(" \t\n\n\n\n")), F.lit("  \n \n\n\n\n")).alias("text"))


def strip_trailing_ws(spark, folder):
    return _padded(spark, folder).select("session_id", "msg_idx", strip_trailing(F.col("text")).alias("text"))


def collapse_blank_runs(spark, folder):
    return _padded(spark, folder).select("session_id", "msg_idx", collapse_blank(F.col("text")).alias("text"))


def trimmed(spark, folder):
    return _padded(spark, folder).select("session_id", "msg_idx", js_trim(F.col("text")).alias("text"))


def json_compact(spark, folder):
    return spark.read.parquet(f"{folder}/events.parquet").select("event_id", compact_json(F.col("props")).alias("props"))


def recent_window_flags(spark, folder):
    m = conversation_messages(spark, folder)
    return m.join(protected_messages(m, 3), "session_id").select("session_id", "msg_idx", (F.col("msg_idx") >= F.col("from_idx")).alias("protected"))


def pairing_integrity(spark, folder):
    """Of results two in seven have no call; the issues that says."""
    t = tool_results(spark, folder)
    call = F.to_json(F.struct(F.lit("assistant").alias("role"), F.array(F.struct(F.lit("toolCall").alias("type"), F.col("tool_call_id").alias("id"), F.lit("ipython").alias("name"), F.create_map(F.lit("code"), F.lit("1")).alias("arguments"))).alias("content")))
    calls = t.messages.where("msg_idx % 7 > 1").withColumns({"raw_json": call, "role": F.lit("assistant"), "msg_idx": -1 - F.col("msg_idx"), "tool_call_id": F.lit(None).cast("string")})
    before = t.messages.unionByName(calls)
    return check_integrity(before, before).groupBy("session_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def role_sequence_check(spark, folder):
    """Roles of a conversation against the same with its first message of role system as user."""
    m = conversation_messages(spark, folder)
    new = m.withColumn("role", F.when((F.col("role") == "system") & (F.col("msg_idx") == 0), "user").otherwise(F.col("role")))
    return changed_roles(m, new).groupBy("session_id").agg(F.count(F.lit(1)).alias("changed"))


def _stats(spark, folder, extra=()):
    t = tool_results(spark, folder)
    return t, *with_stats(t, Options(near=NEAR), extra)


def pipeline_stats(spark, folder):
    return _stats(spark, folder)[2]


def live_stats(spark, folder):
    return with_stats(tool_results(spark, folder), LIVE)[1]


def pass_contribution(spark, folder):
    return pass_totals(_stats(spark, folder, [MINIFY])[2])


def compressed_messages(spark, folder):
    t = tool_results(spark, folder)
    return messages_of(compress(t), t).select("session_id", "msg_idx", "role", "tool_call_id", "raw_json")


def session_report(spark, folder):
    t, out, stats = _stats(spark, folder)
    return session_rows(stats, t.messages, check_integrity(t.messages, messages_of(out, t)))


def grand_totals(spark, folder):
    t, _, stats = _stats(spark, folder)
    return grand_total(session_rows(stats, t.messages, t.messages.select("session_id").limit(0)))


QUERIES = {
    "tool_result_scan": tool_result_scan,
    "role_counts": role_counts,
    "byte_lengths": byte_lengths,
    "utf16_lengths": utf16_lengths,
    "token_estimate": token_estimates,
    "json_sizes": json_sizes,
    "session_bytes": session_bytes,
    "content_fingerprint": content_fingerprint,
    "exact_dedupe": exact_dedupe_query,
    "exact_dedupe_stats": exact_dedupe_stats,
    "block_dedupe": block_dedupe_query,
    "superseded_reads": superseded_reads_query,
    "file_ops_python": file_ops_python,
    "file_ops_bash": file_ops_bash,
    "file_ops_calls": file_ops_calls,
    "runlength_lines": runlength_lines,
    "runlength_runs": runlength_runs,
    "line_similarity_pairs": line_similarity_pairs,
    "near_dupe_best": near_dupe_best,
    "near_dupe_diff": near_dupe_diff,
    "repeated_shingles": repeated_shingles_query,
    "repeated_shingles_all": repeated_shingles_all,
    "shingle_dedupe": shingle_dedupe_query,
    "strip_trailing_ws": strip_trailing_ws,
    "collapse_blank_runs": collapse_blank_runs,
    "js_trim": trimmed,
    "json_compact": json_compact,
    "recent_window_flags": recent_window_flags,
    "pairing_integrity": pairing_integrity,
    "role_sequence_check": role_sequence_check,
    "pipeline_stats": pipeline_stats,
    "live_stats": live_stats,
    "pass_contribution": pass_contribution,
    "compressed_messages": compressed_messages,
    "session_report": session_report,
    "grand_totals": grand_totals,
    **queries_built.QUERIES,
}

_DOCS = "WITH d AS (SELECT lang AS session_id, CAST(doc_id AS INT) AS msg_idx, 'doc-' || doc_id AS tool_call_id, text FROM documents)"
_ESCAPED = "(strlen(text) + len(text) - len(translate(text, '\"\\' || chr(8) || chr(12) || chr(10) || chr(13) || chr(9), '')))"
_PADDED = _DOCS + ", p AS (SELECT session_id, msg_idx, chr(10) || chr(10) || chr(10) || replace(text, chr(10), ' ' || chr(9) || repeat(chr(10), 4)) || '  ' || chr(10) || ' ' || repeat(chr(10), 4) AS text FROM d)"
_CODE = (
    _DOCS
    + r""", c AS (SELECT session_id, msg_idx, '/tmp/' || tool_call_id || '.txt' AS name, regexp_extract(text, '([A-Za-z]+)', 1) AS word, msg_idx % 6 AS k FROM d),
s AS (SELECT session_id, msg_idx,
  'x = ' || word || CASE k WHEN 0 THEN chr(10) || 'open(''' || name || ''', ''w'')' WHEN 1 THEN chr(10) || 'open( "' || name || '" )'
    WHEN 2 THEN chr(10) || 'Path(''' || name || ''') . read_text()' WHEN 3 THEN chr(10) || 'Path(''' || name || ''').write_bytes(x)' || chr(10) || 'open(''b'', ''rb'')'
    WHEN 4 THEN chr(10) || 'open(''' || name || ''', ''w+'')' ELSE chr(10) || 'open(name, ''w'')' END AS py,
  'echo ' || word || CASE k WHEN 0 THEN '; cat ' || name WHEN 1 THEN ' > ' || name WHEN 2 THEN chr(10) || 'head -n 5 ' || name || ' 2>&1'
    WHEN 3 THEN ' >> ' || name || ' && tail ' || name WHEN 4 THEN ' | less -R ' || name ELSE ' nothing' END AS sh FROM c)"""
)
_OPS = """, n AS (SELECT session_id, msg_idx, unnest(range(0, len(ops))) AS n, unnest(ops) AS op FROM o)
SELECT session_id, msg_idx, CAST(n AS INT) AS n, op.path AS path, op.kind AS kind FROM n"""
_PY_OPS = r"""list_concat(
    [struct_pack(path := x.p, kind := CASE WHEN x.m IN ('w', 'wb', 'a', 'ab', 'x', 'xb', 'w+', 'a+') THEN 'write' ELSE 'read' END)
     FOR x IN list_transform(range(1, len(regexp_extract_all(py, P1, 1)) + 1), lambda i: struct_pack(p := regexp_extract_all(py, P1, 1)[i], m := coalesce(regexp_extract_all(py, P1, 2)[i], '')))],
    [struct_pack(path := x, kind := 'read') FOR x IN regexp_extract_all(py, P2, 1)],
    [struct_pack(path := x, kind := 'write') FOR x IN regexp_extract_all(py, P3, 1)])"""
_PY_OPS = (
    _PY_OPS.replace("P1", r"""'\bopen\(\s*(?:r|rb|f)?[''"]([^''"]+)[''"]\s*(?:,\s*[''"]([a-zA-Z]+)[''"])?'""")
    .replace("P2", r"""'\bPath\(\s*[''"]([^''"]+)[''"]\s*\)\s*\.\s*read_(?:text|bytes)\s*\('""")
    .replace("P3", r"""'\bPath\(\s*[''"]([^''"]+)[''"]\s*\)\s*\.\s*write_(?:text|bytes)\s*\('""")
)
_SH_OPS = r"""list_concat(
    [struct_pack(path := x, kind := 'read') FOR x IN regexp_extract_all(sh, '(?:^|[;&|\n]|&&)\s*(?:cat|head|tail|less|more)\s+(?:-\S+\s+)*(\S+)', 1) IF NOT starts_with(x, '-')],
    [struct_pack(path := x, kind := 'write') FOR x IN regexp_extract_all(sh, '>{1,2}\s*(\S+)', 1)])"""
_LINES = _DOCS + ", x AS (SELECT session_id, msg_idx, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k, unnest(string_split(text, chr(10))) AS line FROM d)"
_RUNS = (
    _LINES
    + """, f AS (SELECT *, CASE WHEN line IS DISTINCT FROM lag(line) OVER w THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY session_id, msg_idx ORDER BY k)),
g AS (SELECT *, sum(new) OVER (PARTITION BY session_id, msg_idx ORDER BY k) AS island FROM f),
r AS (SELECT session_id, msg_idx, island, min(k) AS start, count(*) AS n, any_value(line) AS line FROM g GROUP BY ALL)"""
)
_SIMILAR = (
    _DOCS
    + """, e AS (SELECT session_id, msg_idx AS ord, text, len(string_split(text, chr(10))) AS n FROM d WHERE strlen(text) >= 200),
l AS (SELECT session_id, ord, n, text, line, count(*) AS c FROM (SELECT session_id, ord, n, text, unnest(string_split(text, chr(10))) AS line FROM e) GROUP BY ALL),
s AS (SELECT a.session_id, a.ord, b.ord AS cand, 2 * CAST(sum(least(a.c, b.c)) AS DOUBLE) / (any_value(a.n) + any_value(b.n)) AS sim
      FROM l a JOIN l b ON a.session_id = b.session_id AND a.line = b.line AND b.ord < a.ord AND a.text <> b.text GROUP BY ALL),
t AS (SELECT * FROM s WHERE sim >= 0.5)"""
)
_BLANK = """, l AS (SELECT session_id, msg_idx, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM p)"""

ORACLES = {
    "tool_result_scan": _DOCS + " SELECT session_id, msg_idx, tool_call_id, strlen(text) AS n_bytes FROM d",
    "role_counts": "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS sessions FROM conversations GROUP BY role",
    "byte_lengths": _DOCS + " SELECT session_id, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, max(strlen(text)) AS longest FROM d GROUP BY session_id",
    "utf16_lengths": _DOCS + ", u AS (SELECT session_id, msg_idx, len(text) + len(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units FROM d) SELECT session_id, msg_idx, units, units + 2 AS units_more FROM u",
    "token_estimate": _DOCS + " SELECT session_id, msg_idx, CAST(floor(strlen(text) / CAST(4 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS tokens FROM d",
    "json_sizes": _DOCS + f" SELECT session_id, msg_idx, {_ESCAPED} AS json_bytes FROM d",
    "session_bytes": _DOCS
    + f""", j AS (SELECT session_id, {_ESCAPED} + strlen('{{"role":"toolResult","toolCallId":"","content":[{{"type":"text","text":""}}]}}') + strlen(tool_call_id) AS n FROM d)
SELECT session_id, count(*) AS messages, CAST(2 + sum(n) + count(*) - 1 AS BIGINT) AS bytes FROM j GROUP BY session_id""",
    "content_fingerprint": _DOCS + " SELECT session_id, msg_idx, sha256('text:' || text) AS fingerprint, strlen(text) AS n_bytes, text AS shown FROM d",
    "exact_dedupe": _DOCS
    + """, r AS (SELECT *, strlen(text) AS n, row_number() OVER w AS k, first_value(tool_call_id) OVER w AS first_id FROM d WHERE strlen(text) >= 40 WINDOW w AS (PARTITION BY session_id, text ORDER BY msg_idx))
SELECT session_id, msg_idx, tool_call_id, CASE WHEN k > 1 THEN '[identical to output of toolCallId ' || first_id || ', ' || n || ' bytes elided]' ELSE text END AS text FROM r
UNION ALL SELECT session_id, msg_idx, tool_call_id, text FROM d WHERE strlen(text) < 40""",
    "exact_dedupe_stats": _DOCS
    + """, r AS (SELECT *, strlen(text) AS n, row_number() OVER w AS k, first_value(tool_call_id) OVER w AS first_id FROM d WHERE strlen(text) >= 40 WINDOW w AS (PARTITION BY session_id, text ORDER BY msg_idx))
SELECT session_id, count(*) AS hits, CAST(sum(n - strlen('[identical to output of toolCallId ' || first_id || ', ' || n || ' bytes elided]')) AS BIGINT) AS saved FROM r WHERE k > 1 GROUP BY session_id""",
    "block_dedupe": _DOCS
    + """, r AS (SELECT *, strlen(text) AS n, row_number() OVER w AS k, first_value(tool_call_id) OVER w AS first_id FROM d WHERE strlen(text) >= 200 WINDOW w AS (PARTITION BY session_id, text ORDER BY msg_idx))
SELECT session_id, msg_idx, 0 AS block_idx, CASE WHEN k > 1 THEN '[identical text block to output of toolCallId ' || first_id || ', ' || n || ' bytes elided]' ELSE text END AS text FROM r
UNION ALL SELECT session_id, msg_idx, 0, text FROM d WHERE strlen(text) < 200""",
    "superseded_reads": """
WITH e AS (SELECT user_id AS path, event_id AS idx, event_type = 'view' AS is_read FROM events WHERE event_type IN ('view', 'purchase')),
s AS (SELECT *, max(CASE WHEN is_read THEN idx END) OVER (PARTITION BY path) AS last_read,
      min(CASE WHEN NOT is_read THEN idx END) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_write FROM e)
SELECT DISTINCT 'all' AS session_id, idx FROM s WHERE is_read AND idx <> last_read AND next_write < last_read""",
    "file_ops_python": _CODE + f", o AS (SELECT session_id, msg_idx, {_PY_OPS} AS ops FROM s)" + _OPS,
    "file_ops_bash": _CODE + f", o AS (SELECT session_id, msg_idx, {_SH_OPS} AS ops FROM s)" + _OPS,
    "file_ops_calls": _CODE
    + f""", o AS (SELECT session_id, msg_idx, CASE msg_idx % 5 WHEN 0 THEN [struct_pack(path := '/p/' || msg_idx, kind := 'write')] WHEN 1 THEN [struct_pack(path := '/p/' || msg_idx, kind := 'read')]
  WHEN 2 THEN {_SH_OPS} WHEN 3 THEN {_SH_OPS.replace("(sh,", "('%%bash' || chr(10) || sh,")} ELSE [] END AS ops FROM s),
n AS (SELECT session_id, unnest(ops) AS op FROM o)
SELECT session_id, op.kind AS kind, count(*) AS n, count(DISTINCT op.path) AS paths FROM n GROUP BY ALL""",
    "runlength_lines": _RUNS
    + """ SELECT session_id, msg_idx, string_agg(CASE WHEN n >= 3 THEN line || ' (×' || n || ')' ELSE line || repeat(chr(10) || line, CAST(n - 1 AS INT)) END, chr(10) ORDER BY start) AS text
FROM r GROUP BY session_id, msg_idx""",
    "runlength_runs": _RUNS + " SELECT session_id, msg_idx, CAST(start AS INT) AS start, CAST(n AS INT) AS n FROM r WHERE n >= 3",
    "line_similarity_pairs": _SIMILAR + " SELECT session_id, ord, cand, sim FROM t",
    "near_dupe_best": _SIMILAR + " SELECT session_id, ord, cand, sim FROM (SELECT *, row_number() OVER (PARTITION BY session_id, ord ORDER BY sim DESC, cand) AS k FROM t) WHERE k = 1",
    "repeated_shingles": _DOCS
    + """, p AS (SELECT session_id, msg_idx, pos, substr(text, pos + 1, 64) AS shingle FROM (SELECT session_id, msg_idx, text, CAST(unnest(range(0, len(text) - 63, 64)) AS INT) AS pos FROM d WHERE len(text) >= 64))
SELECT session_id, shingle, count(*) AS n, min((msg_idx, pos))[1] AS first_msg, min((msg_idx, pos))[2] AS first_at FROM p GROUP BY session_id, shingle HAVING count(*) > 1""",
    "strip_trailing_ws": _PADDED + _BLANK + " SELECT session_id, msg_idx, string_agg(rtrim(line, ' ' || chr(9)), chr(10) ORDER BY k) AS text FROM l GROUP BY session_id, msg_idx",
    "collapse_blank_runs": _PADDED
    + _BLANK
    + """, b AS (SELECT *, sum(CASE WHEN line <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, msg_idx ORDER BY k) AS island FROM l),
c AS (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, msg_idx, island) AS blanks,
      sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, msg_idx, island ORDER BY k) AS nth FROM b)
SELECT session_id, msg_idx, string_agg(line, chr(10) ORDER BY k) AS text FROM c WHERE line <> '' OR blanks < 3 OR nth = 1 GROUP BY session_id, msg_idx""",
    "js_trim": _PADDED + " SELECT session_id, msg_idx, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS text FROM p",
    "json_compact": "SELECT event_id, CASE WHEN props LIKE '{%' AND strlen(CAST(json(props) AS VARCHAR)) < strlen(props) THEN CAST(json(props) AS VARCHAR) ELSE props END AS props FROM events",
    "recent_window_flags": "SELECT conv_id AS session_id, turn AS msg_idx, turn >= count(*) OVER (PARTITION BY conv_id) - 3 AS protected FROM conversations",
    "pairing_integrity": _DOCS + " SELECT session_id, 'result_orphan' AS rule, count(*) AS n FROM d WHERE msg_idx % 7 <= 1 GROUP BY session_id",
    "role_sequence_check": "SELECT conv_id AS session_id, count(*) AS changed FROM conversations WHERE role = 'system' AND turn = 0 GROUP BY conv_id",
    **queries_built.ORACLES,
}
