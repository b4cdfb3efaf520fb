"""JSON as JavaScript parses and prints it."""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

_ESCAPED = re.compile(r'["\\\x00-\x1f\ud800-\udfff]')
_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_INDEX = re.compile(r"0|[1-9][0-9]{0,9}")
#: Fixed value: the characters that String.prototype.trim removes.
SPACE = "\t\n\x0b\f\r \xa0                　﻿"


def _refuse(name: str):
    raise ValueError(name)


def parse(text: str):
    """Values with numbers as doubles; raises ValueError for what JavaScript refuses."""
    return json.loads(text, parse_int=float, parse_float=float, parse_constant=_refuse)


def number(x: float) -> str:
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    sign, digits, shift = Decimal(repr(x)).as_tuple()
    s = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + shift  # places before the decimal point
    if 0 < point <= 21:
        out = s.ljust(point, "0") if len(s) <= point else f"{s[:point]}.{s[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + s
    else:
        out = s[0] + ("." + s[1:] if len(s) > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * sign + out


def string(s: str) -> str:
    # A pair of surrogates that stands for one character is printed as that character.
    if any("\ud800" <= c <= "\udfff" for c in s):
        s = s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")
    return '"' + _ESCAPED.sub(lambda m: _SHORT.get(m[0], f"\\u{ord(m[0]):04x}"), s) + '"'


def _keys(d: dict) -> list[str]:
    """Array indices first, in order, then the others as they came."""
    indices = {k for k in d if _INDEX.fullmatch(k) and int(k) < 2**32 - 1}
    return sorted(indices, key=int) + [k for k in d if k not in indices]


def stringify(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int | float):
        return number(float(v))
    if isinstance(v, str):
        return string(v)
    if isinstance(v, list):
        return "[" + ",".join(map(stringify, v)) + "]"
    return "{" + ",".join(f"{string(k)}:{stringify(v[k])}" for k in _keys(v)) + "}"


def utf16_len(s: str) -> int:
    return len(s) + sum(c > "￿" for c in s)


def compact(text: str) -> str:
    """A text that is one JSON object or array, printed without spaces if that is shorter; any other text as it is."""
    trimmed = text.strip(SPACE)
    if not trimmed.startswith(("{", "[")):
        return text
    try:
        out = stringify(parse(trimmed))
        same = stringify(parse(out)) == out
    except (ValueError, RecursionError):
        return text
    return out if same and utf16_len(out) < utf16_len(trimmed) else text
