"""Line diffs: a longest common subsequence, shown with long unchanged runs left out."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby
from math import isqrt

#: Unchanged lines that are shown on either side of what is left out.
EDGE = 2
SIGN = {"equal": "  ", "remove": "- ", "add": "+ "}


def _masks(lines: list[str]) -> Callable[[str], int]:
    """Of a line the places in lines that are equal to it, as bits, the last place being the lowest. Those of lines that are often there are kept."""
    at: dict[str, list[int]] = {}
    for k, line in enumerate(reversed(lines)):
        at.setdefault(line, []).append(k)
    often, kept = isqrt(len(lines)), {}

    def mask(line: str) -> int:
        if line not in at or line in kept:
            return kept.get(line, 0)
        bits = bytearray(at[line][-1] // 8 + 1)
        for k in at[line]:
            bits[k >> 3] |= 1 << (k & 7)
        out = int.from_bytes(bits, "little")
        if len(at[line]) > often:
            kept[line] = out
        return out

    return mask


def diff_lines(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """[(equal | remove | add, line)] that turns old into new; where both would do, a removal comes first.

    The table of lines in common that are still to come from old[i:] and new[j:] is held by its steps, a bit each: a row
    of steps along new is an integer, and an addition makes the next row of it. Every sqrt(n)-th row is kept and those
    between are made again, so that memory grows with m * sqrt(n) bits.
    """
    same = next((k for k, (x, y) in enumerate(zip(old, new, strict=False)) if x != y), min(len(old), len(new)))
    out, old, new = [("equal", x) for x in old[:same]], old[same:], new[same:]
    n, m = len(old), len(new)
    mask, block = _masks(new), isqrt(n) + 1

    def up(i: int, flat: int, full: int) -> tuple[int, int]:
        """Row i of the row below it: where it has no step along new, and where it has one along old."""
        hit = flat & mask(old[i])
        total = flat + hit
        return (total | (flat - hit)) & full, (flat ^ hit ^ total) >> 1

    rows = {n: (1 << m) - 1}
    flat = rows[n]
    for i in range(n - 1, block - 1, -1):
        flat, _ = up(i, flat, rows[n])
        if i % block == 0:
            rows[i] = flat
    j = 0
    for lo in range(0, n, block):
        hi = min(lo + block, n)
        full = (1 << (m - j)) - 1  # places before j are done with
        flat, steps = rows[hi] & full, [0] * (hi - lo)
        for i in range(hi - 1, lo - 1, -1):
            flat, steps[i - lo] = up(i, flat, full)
        i = lo
        while i < hi:
            if j < m and old[i] == new[j]:
                out.append(("equal", old[i]))
                i, j = i + 1, j + 1
            elif j == m or not steps[i - lo] >> (m - 1 - j) & 1:
                out.append(("remove", old[i]))
                i += 1
            else:
                out.append(("add", new[j]))
                j += 1
    return out + [("add", x) for x in new[j:]]


def render_diff(ops: list[tuple[str, str]]) -> str:
    shown: list[str] = []
    for kind, run in groupby(ops, key=lambda op: op[0]):
        lines = [SIGN[kind] + line for _, line in run]
        if kind == "equal" and len(lines) > 2 * EDGE:
            lines[EDGE:-EDGE] = [f"  ... ({len(lines) - 2 * EDGE} unchanged lines elided) ..."]
        shown += lines
    return "\n".join(shown)


def bag_similarity(a: list[str], b: list[str]) -> float:
    """Twice the lines in common, with their counts, by the lines of both; 1 for two empty lists."""
    if not a and not b:
        return 1.0
    counts: dict[str, int] = {}
    for line in a:
        counts[line] = counts.get(line, 0) + 1
    common = 0
    for line in b:
        if counts.get(line, 0) > 0:
            counts[line] -= 1
            common += 1
    return 2 * common / (len(a) + len(b))
