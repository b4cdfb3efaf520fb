"""Lengths, white space and rounding as JavaScript has them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that JavaScript's \s matches, as the inside of a Java character class.
JS_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def utf8_len(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def utf16_len(s: Column) -> Column:
    """Code units: one more than code points for each character beyond U+FFFF."""
    return F.floor(F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long")


def js_trim(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, rf"\A[{JS_SPACE}]+", ""), rf"(?<![{JS_SPACE}])[{JS_SPACE}]+\z", "")


def js_round(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def token_estimate(n_bytes: Column) -> Column:
    return js_round(n_bytes / F.lit(4.0))


def json_string_len(s: Column) -> Column:
    """Bytes of the string as a JSON string without its quotes: short escapes take one more, other controls five more."""
    plain = utf8_len(s)
    short = F.length(s) - F.length(F.translate(s, '"\\\b\f\n\r\t', ""))
    other = F.length(s) - F.length(F.regexp_replace(s, r"[\x00-\x07\x0B\x0E-\x1F]", ""))
    return (plain + short + 5 * other).cast("long")


def text_block_len(s: Column) -> Column:
    """Bytes of {"type":"text","text":...}."""
    return F.lit(len('{"type":"text","text":""}')) + json_string_len(s)
