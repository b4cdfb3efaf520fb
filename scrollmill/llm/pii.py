"""Personal data: candidate spans judged by boosted trees; DataFrame functions only.

Strict patterns with checks find the base spans. Loose generators propose further, overlapping spans: what the patterns
find, the same spelt around or with other separators, and what only looks like it. A proposal is confirmed or refuted by
a strict rule where its spelling lets one decide, else it is open. Each is described by yes/no features of its format,
without what tells a strict spelling from another, and of the text before it, so that all proposals of a corpus sum up to
a table of bounded size: how often each combination of features was confirmed, and how often refuted. Gradient-boosted
trees are grown on that table. Thresholds by generator are set on proposals that trees grown without them have scored,
and what reaches them is added to the base spans, open proposals above all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds. Possessive where that cannot change a match, so that long texts take linear time and
#: no stack. Cards are matched from 16 digits on, as shorter runs would be dropped.
LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that each match must have, so that most texts are passed over quickly.
#: A character that each match must have, or a pattern that finds one, so that most texts are passed over quickly.
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
NEEDS = {"email": "@", "ip": r"\.", "card": "[0-9]", "phone": r"\+", "contact": r"@|[({<\[]\x20?at\x20?[)}>\]]|\x20at\x20", "number": "[0-9]", "dotted": "[0-9]", "secret": "[0-9]"}

#: Generators of proposals: addresses that may be spelt around, long groups of digits, dotted numbers, and long strings
#: of letters and digits.
AT, DOT = r"(?:\x20?@\x20?|\x20?[({<\[]\x20?at\x20?[)}>\]]\x20?)", r"(?:\.|\x20?[({<\[]\x20?(?:dot|\.)\x20?[)}>\]]\x20?)"
PROPOSE = {
    "contact": rf"(?:\G|(?<!{LOCAL})){LOCAL}++(?:{AT}{HOST}++(?:{DOT}{HOST}++)++|\x20at\x20{HOST}++(?:\x20dot\x20{HOST}++)++)",
    "number": r"(?<![A-Za-z0-9])\+?\(?[0-9](?:[\x20()./_-]{0,2}+[0-9]){6,}+(?![A-Za-z0-9])",
    "dotted": rf"(?<![A-Za-z0-9.])[0-9]{{1,5}}(?:{DOT}[0-9]{{1,5}}){{2,8}}+(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+=*+(?![A-Za-z0-9])",
}
#: How many characters before a proposal are looked at.
CONTEXT = 48
WORDS_BEFORE = r"(?i)(?:mail|phone|tel|call|fax|card|visa|account|contact|reach|write|address|ssn|iban|server|host|login)"
#: What a value is assigned to: names of secrets, and names of things that look like secrets.
SECRET_NAMES = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth(?:orization)?|credentials?)[\x22']?\s*(?:=>|[:=])\s*(?:bearer\s+)?[\x22']?$"
PLAIN_NAMES = r"(?i)(?:id|class|href|src|sha[0-9]*|md5|hash|commit|rev|checksum|digest|etag|integrity|uuid|guid|url|link|file|path|version|name)[\x22']?\s*(?:=>|[:=])\s*[\x22']?$"
ASSIGNED = r"(?:=>|[:=])\s*[\x22']?$"


def _q(pattern: str) -> str:
    """The pattern as a SQL literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _meets(kinds: str) -> str:
    return f"exists(base, b -> b.kind in ({kinds}) and b.s < y.e and y.s < b.e)"


#: SQL by generator: whether a proposal y is confirmed, and whether it is open; else it is refuted.
#: y.t is its text, y.d its digits, y.c the text before it.
CONFIRMED = {"contact": _meets("'email'"), "number": _meets("'card', 'phone'"), "dotted": _meets("'ip'"), "secret": f"y.c rlike {_q(SECRET_NAMES)}"}
OPEN = {
    "contact": f"not y.t rlike {_q(f'{LOCAL}@{HOST}')}",
    "number": f"y.t rlike {_q('[()./_]|[ -]{2}')} or {_meets(_q('ip'))}",
    "dotted": f"y.t rlike {_q(r'[({<\[]')}",
    "secret": f"y.c rlike {_q(ASSIGNED)} and not y.c rlike {_q(PLAIN_NAMES)}",
}
#: None tells a spelling that the base patterns take from one that they do not. The check sum is none either, so that what
#: only just fails it can be taken.
FEATURES: dict[str, str] = {
    "address": "y.kind = 'contact'",
    "long": "length(y.t) >= 32",
    "10 digits": "length(y.d) >= 10",
    "13 digits": "length(y.d) >= 13",
    "16 digits": "length(y.d) >= 16",
    "20 digits": "length(y.d) >= 20",
    "paren": "y.kind = 'number' and contains(y.t, '(')",
    "fours": f"y.t rlike {_q(r'^[0-9]{4}(?:[^0-9]{0,2}[0-9]{4}){3}')}",
    "gaps": f"y.kind = 'number' and y.t rlike {_q('[0-9][^0-9]')}",
    "word before": f"y.c rlike {_q(WORDS_BEFORE)}",
    "sign before": f"y.c rlike {_q(r'[#=/:\x22]\s?$')}",
    "half digits": "length(y.d) * 2 >= length(y.t)",
    "hexadecimal": f"y.kind = 'secret' and y.t rlike {_q('^(?:[0-9a-f]+|[0-9A-F]+)$')}",
    "mixed": f"y.kind = 'secret' and y.t rlike {_q('[a-z]')} and y.t rlike {_q('[A-Z]')}",
    "dotted": "y.kind = 'dotted'",
    "secret": "y.kind = 'secret'",
    "four parts": f"y.kind = 'dotted' and y.t rlike {_q('^[0-9]+(?:[^0-9]+[0-9]+){3}$')}",
    "octets": f"y.kind = 'dotted' and y.t rlike {_q(f'^{OCTET}(?:[^0-9]+{OCTET}){{2,8}}$')}",
    "3-3-4": f"y.kind = 'number' and y.t rlike {_q(r'[0-9]{3}[^0-9]{0,2}[0-9]{3}[^0-9]{0,2}[0-9]{4}$')}",
    "quoted": f"y.c rlike {_q(r'[\x22\x27]$')}",
    "parted": f"y.kind = 'secret' and y.t rlike {_q('[/_-]')}",
}
NAMES = list(FEATURES)


def kind_of(cell: int) -> str:
    """The generator of a combination of features."""
    return next((k for k, name in (("contact", "address"), ("dotted", "dotted"), ("secret", "secret")) if cell >> NAMES.index(name) & 1), "number")


#: Matches of a text whose places are counted at once.
STRIDE = 512


def _found(text: str, pattern: str, needs: str) -> str:
    """SQL for the pattern's matches in a text column: array<struct<s, e, t>>, places counted in code points, end exclusive.

    Places are sums over the matches before, taken by STRIDE of them, as an array that grows is copied at each step.
    """
    none = "cast(array() as array<struct<s:int,e:int,t:string>>)"
    pieces = f"transform(slice(split({text}, {_q(pattern)}, -1), 1, size(m)), (p, i) -> named_struct('g', length(p), 't', m[i]))"
    parts = f"transform(array({pieces}), q -> transform(sequence(0, (size(q) - 1) div {STRIDE}), c -> slice(q, cast(c * {STRIDE} + 1 as int), {STRIDE})))[0]"
    held = "cast(array() as array<struct<at:int,part:array<struct<g:int,t:string>>>>)"
    size = "aggregate(x, 0, (n, y) -> n + y.g + length(y.t))"
    placed = f"aggregate({parts}, named_struct('pos', 0, 'out', {held}), (acc, x) -> named_struct('pos', acc.pos + {size}, 'out', array_append(acc.out, named_struct('at', acc.pos, 'part', x))), acc -> acc.out)"
    step = "acc.pos + x.g"
    walk = (
        f"aggregate(o.part, named_struct('pos', o.at, 'out', {none}), "
        f"(acc, x) -> named_struct('pos', {step} + length(x.t), 'out', array_append(acc.out, named_struct('s', {step}, 'e', {step} + length(x.t), 't', x.t))), acc -> acc.out)"
    )
    matches = f"case when {text} rlike {_q(needs)} then regexp_extract_all({text}, {_q(pattern)}, 0) else cast(array() as array<string>) end"
    return f"element_at(transform(array({matches}), m -> case when size(m) = 0 then {none} else flatten(transform({placed}, o -> {walk})) end), 1)"


def _valid(kind: str) -> str:
    digits = "regexp_replace(x.t, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"x.t rlike '^{OCTET}(?:\\\\.{OCTET}){{3}}$'",
        "card": f"length({digits}) between 16 and 19 and luhn_check({digits})",
        "phone": f"length({digits}) between 8 and 15",
    }[kind]


def find(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, base array<struct<kind, s, e>>, proposals array<struct<kind, s, e, cell, hit>>), base in order of kind and start.

    cell has a bit for each feature that a proposal has; hit says whether it is confirmed, null if it is open.
    """
    x = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for kind, pattern in BASE.items():
        x = x.withColumn(f"raw_{kind}", F.expr(_found("text", pattern, NEEDS[kind])))
    parts = [f"transform(filter(raw_{k}, x -> {_valid(k)}), x -> named_struct('kind', '{k}', 's', x.s, 'e', x.e))" for k in BASE]
    x = x.withColumn("base", F.expr(f"concat({', '.join(parts)})")).drop(*(f"raw_{k}" for k in BASE))
    for kind, pattern in PROPOSE.items():
        x = x.withColumn(f"raw_{kind}", F.expr(_found("text", pattern, NEEDS[kind])))
    parts = []
    for k in PROPOSE:
        bits = " | ".join(f"(case when {f} then {1 << i} else 0 end)" for i, f in enumerate(FEATURES.values()))
        seen = f"named_struct('kind', '{k}', 's', x.s, 'e', x.e, 't', x.t, 'd', regexp_replace(x.t, '[^0-9]', ''), 'c', substring(text, greatest(x.s - {CONTEXT}, 0) + 1, least(x.s, {CONTEXT})))"
        hit = f"case when {CONFIRMED[k]} then true when {OPEN[k]} then cast(null as boolean) else false end"
        parts.append(f"transform(transform(raw_{k}, x -> {seen}), y -> named_struct('kind', y.kind, 's', y.s, 'e', y.e, 'cell', {bits}, 'hit', {hit}))")
    return x.withColumn("proposals", F.expr(f"concat({', '.join(parts)})")).drop(*(f"raw_{k}" for k in PROPOSE))


# Boosted trees over the cells


@dataclass
class Tree:
    """A leaf with a value, or a feature with a subtree for each answer."""

    value: float = 0.0
    feature: int | None = None
    yes: Tree | None = None
    no: Tree | None = None

    def __call__(self, cell: int) -> float:
        if self.feature is None:
            return self.value
        return (self.yes if cell >> self.feature & 1 else self.no)(cell)

    def sql(self, cell: str) -> str:
        if self.feature is None:
            return repr(self.value) + "D"
        return f"case when ({cell} & {1 << self.feature}) <> 0 then {self.yes.sql(cell)} else {self.no.sql(cell)} end"


@dataclass
class Booster:
    base: float
    trees: list[Tree] = field(default_factory=list)
    least: dict[str, float] = field(default_factory=dict)  # by generator, the probability from which a proposal is taken

    def score(self, cell: int) -> float:
        return 1 / (1 + math.exp(-(self.base + sum(t(cell) for t in self.trees))))

    def sql(self, cell: str) -> str:
        total = " + ".join([f"{self.base!r}D", *(f"({t.sql(cell)})" for t in self.trees)])
        return f"(1 / (1 + exp(-({total}))))"


def _grow(cells: list[tuple[int, float, float]], depth: int, smooth: float) -> Tree:
    """A tree on (cell, gradient, curvature) that gains the most at each split."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best = (1e-9, None)
    for f in range(len(NAMES)) if depth else ():
        gy, hy = sum(c[1] for c in cells if c[0] >> f & 1), sum(c[2] for c in cells if c[0] >> f & 1)
        gain = gy * gy / (hy + smooth) + (g - gy) ** 2 / (h - hy + smooth) - g * g / (h + smooth)
        if gain > best[0]:
            best = (gain, f)
    if best[1] is None:
        return Tree(-g / (h + smooth))
    f = best[1]
    return Tree(feature=f, yes=_grow([c for c in cells if c[0] >> f & 1], depth - 1, smooth), no=_grow([c for c in cells if not c[0] >> f & 1], depth - 1, smooth))


def boost(table: Sequence[tuple[int, float, float]], rounds: int = 24, depth: int = 3, rate: float = 0.4, smooth: float = 1.0) -> Booster:
    """Logistic boosting on (cell, times it was right, times it was not)."""
    pos, neg = sum(r[1] for r in table), sum(r[2] for r in table)
    model = Booster(math.log((pos + 1) / (neg + 1)))
    margin = {cell: model.base for cell, *_ in table}
    for _ in range(rounds if pos + neg else 0):
        now = []
        for cell, y, n in sorted(table):
            p = 1 / (1 + math.exp(-margin[cell]))
            now.append((cell, (y + n) * p - y, (y + n) * p * (1 - p)))
        tree = _grow(now, depth, smooth)
        for t in _leaves(tree):
            t.value *= rate
        model.trees.append(tree)
        for cell in margin:
            margin[cell] += tree(cell)
    return model


def _leaves(t: Tree) -> list[Tree]:
    return [t] if t.feature is None else _leaves(t.yes) + _leaves(t.no)


def thresholds(scored: Sequence[tuple[str, float, float, float]], precision: float) -> dict[str, float]:
    """For each generator, the lowest score from which proposals were right as often as `precision`; scored: (generator, score, times right, times wrong)."""
    least = {}
    for kind in PROPOSE:
        own = sorted(((score, y, n) for k, score, y, n in scored if k == kind), reverse=True)
        least[kind], right, wrong = 2.0, 0.0, 0.0
        for k, (score, y, n) in enumerate(own):
            right, wrong = right + y, wrong + n
            if right >= precision * (right + wrong + 1) and (k + 1 == len(own) or own[k + 1][0] < score):
                least[kind] = score
    return least


def calibrate(model: Booster, table: Sequence[tuple[int, float, float]], precision: float) -> None:
    """Set the thresholds of a model on a table that it was not grown on."""
    model.least = thresholds([(kind_of(c), model.score(c), y, n) for c, y, n in table], precision)


FOLDS = 5


def learn(found: DataFrame, precision: float = 0.9) -> Booster:
    """Grown on what is confirmed and refuted; each fifth of the documents is scored by trees grown on the others, which gives the thresholds.

    Of each combination of features at most 2 * FOLDS counts reach the driver; there are about as many as those that texts
    show, some hundreds, and 2 ** len(FEATURES) at most.
    """
    p = found.select("id", F.explode("proposals").alias("p")).where("p.hit is not null")
    fold = F.pmod(F.xxhash64("id"), F.lit(FOLDS))
    counts = p.groupBy(F.col("p.cell").alias("cell"), fold.alias("fold"), F.col("p.hit").alias("hit")).count().collect()

    def table(rows) -> list[tuple[int, float, float]]:
        out: dict[int, list[float]] = {}
        for r in rows:
            out.setdefault(r["cell"], [0.0, 0.0])[not r["hit"]] += r["count"]
        return [(cell, y, n) for cell, (y, n) in sorted(out.items())]

    scored = []
    for k in range(FOLDS):
        grown = boost(table(r for r in counts if r["fold"] != k))
        scored += [(kind_of(c), grown.score(c), y, n) for c, y, n in table(r for r in counts if r["fold"] == k)]
    model = boost(table(counts))
    model.least = thresholds(scored, precision)
    return model


def mark_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.9) -> DataFrame:
    """One row for each of docs: (id, text, base, added), spans in order of kind and start.

    base has what the strict patterns find, leftmost and not overlapping within a kind. added has the proposals whose
    probability reaches their generator's threshold and that no base span overlaps. A null text counts as empty and has
    none; a table without proposals adds none. Rows are judged one by one, so repeated rows and ids agree. Other columns
    are not read. No rows: no rows.
    """
    found = find(docs, id_col, text_col)
    model = learn(found, precision)
    take = " or ".join(f"(p.kind = '{k}' and {model.sql('p.cell')} >= {v!r}D)" for k, v in model.least.items() if v <= 1) or "false"
    clear = "not exists(base, b -> b.s < p.e and p.s < b.e)"
    added = f"transform(filter(filter(proposals, p -> {clear}), p -> {take}), p -> named_struct('kind', p.kind, 's', p.s, 'e', p.e))"
    return found.select("id", "text", "base", F.expr(added).alias("added"))


def redact(marked: DataFrame) -> DataFrame:
    """(id, text): the texts of mark_private with each span's characters replaced by `[kind]`; of spans that overlap the first is named.

    A text without spans stays, a null one is empty; repeated rows agree. No rows: no rows.
    """
    order = "array_sort(concat(base, added), (a, b) -> case when a.s <> b.s then a.s - b.s when a.e <> b.e then b.e - a.e else 0 end)"
    walk = f"""aggregate({order}, named_struct('pos', 0, 'out', cast(array() as array<string>)), (acc, x) -> case
        when x.s >= acc.pos then named_struct('pos', x.e, 'out', concat(acc.out, array(substring(text, acc.pos + 1, x.s - acc.pos), concat('[', x.kind, ']'))))
        else named_struct('pos', greatest(acc.pos, x.e), 'out', acc.out) end,
        acc -> concat(array_join(acc.out, ''), substring(text, acc.pos + 1, length(text))))"""
    return marked.select("id", F.expr(walk).alias("text"))


def _listed(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    marked = mark_private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    more = [F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added") > 0).alias("private")]
    return marked.select(F.col("id").alias("doc_id"), *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("concat(base, added)").alias("spans"), *more)
