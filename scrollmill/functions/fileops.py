"""File reads and writes in the arguments of tool calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrollmill.functions.text import JS_SPACE

S, NOT_S = f"[{JS_SPACE}]", f"[^{JS_SPACE}]"
#: The patterns that tell operations, the modes in which open() writes, and the tools that write and read.
PY_OPEN = rf"""\bopen\({S}*(?:r|rb|f)?['"]([^'"]+)['"]{S}*(?:,{S}*['"]([a-zA-Z]+)['"])?"""
PY_PATH_READ = rf"""\bPath\({S}*['"]([^'"]+)['"]{S}*\){S}*\.{S}*read_(?:text|bytes){S}*\("""
PY_PATH_WRITE = rf"""\bPath\({S}*['"]([^'"]+)['"]{S}*\){S}*\.{S}*write_(?:text|bytes){S}*\("""
BASH_READ = rf"(?:^|[;&|\n]|&&){S}*(?:cat|head|tail|less|more){S}+(?:-{NOT_S}+{S}+)*({NOT_S}+)"
BASH_WRITE = rf">{{1,2}}{S}*({NOT_S}+)"
WRITE_MODES = ["w", "wb", "a", "ab", "x", "xb", "w+", "a+"]
WRITE_TOOLS = ["edit", "write", "write_file", "create_file"]
READ_TOOLS = ["read", "read_file", "view"]

OPS = "array<struct<path:string,kind:string>>"


def _ops(paths: Column, kind: str) -> Column:
    return F.transform(F.filter(paths, lambda p: p != ""), lambda p: F.struct(p.alias("path"), F.lit(kind).alias("kind")))


def python_ops(code: Column) -> Column:
    """open() calls first, then Path reads, then Path writes, each in the order of the text."""
    opened = F.arrays_zip(F.regexp_extract_all(code, F.lit(PY_OPEN), F.lit(1)).alias("path"), F.regexp_extract_all(code, F.lit(PY_OPEN), F.lit(2)).alias("mode"))
    opens = F.transform(opened, lambda o: F.struct(o["path"].alias("path"), F.when(o["mode"].isin(WRITE_MODES), "write").otherwise("read").alias("kind")))
    return F.concat(opens, _ops(F.regexp_extract_all(code, F.lit(PY_PATH_READ), F.lit(1)), "read"), _ops(F.regexp_extract_all(code, F.lit(PY_PATH_WRITE), F.lit(1)), "write"))


def bash_ops(command: Column) -> Column:
    """Files shown first, then redirections."""
    reads = F.filter(F.regexp_extract_all(command, F.lit(BASH_READ), F.lit(1)), lambda p: ~p.startswith("-"))
    return F.concat(_ops(reads, "read"), _ops(F.regexp_extract_all(command, F.lit(BASH_WRITE), F.lit(1)), "write"))


def _string_arg(args: Column, key: str) -> Column:
    """The argument if it is a JSON string, else null."""
    v = F.try_variant_get(F.try_parse_json(args), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(F.try_parse_json(args), f"$.{key}", "string"))


def file_ops(tool: Column, args: Column) -> Column:
    """array<struct<path, kind>> of a call; empty for tools and arguments that are not known."""
    path, command, code = (_string_arg(args, k) for k in ("path", "command", "code"))

    def one(kind: str) -> Column:
        return F.array(F.struct(path.alias("path"), F.lit(kind).alias("kind")))

    cell = F.when(code.rlike(rf"\A{S}*%%bash"), bash_ops(code)).otherwise(python_ops(code))
    found = (
        F.when(tool.isin(WRITE_TOOLS) & path.isNotNull(), one("write"))
        .when(tool.isin(READ_TOOLS) & path.isNotNull(), one("read"))
        .when((tool == "bash") & command.isNotNull(), bash_ops(command))
        .when((tool == "ipython") & code.isNotNull(), cell)
    )
    return F.coalesce(found.cast(OPS), F.array().cast(OPS))
