"""All matches of a pattern with their places, in built-in expressions.

Matches and the gaps between them come from regexp_extract_all and split; places are running sums of their lengths.
A sum that appends to an array copies it, so it runs over chunks of CHUNK matches and then over the chunks: linear in
the number of matches but for a small factor. Line and page numbers are running sums alike, of gaps and of matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let

CHUNK = 256
LINE, PAGE = "\n", "\f"
EMPTY = "cast(array() as array<struct<s:int,e:int,v:string,nl:int,pg:int,ln:int>>)"


def _count(s: str, char: str) -> str:
    return f"(length({s}) - length(replace({s}, '{char}', '')))"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, needs: str | None = None) -> Column:
    """array<struct<s, e, v, nl, pg, ln>> for a column name: start, end (code points, end exclusive), value, newlines before
    the start, page breaks before it, newlines since the last page break. needs: a cheap pattern without which there
    can't be a match. The pattern must not match the empty string. A null text has no match."""
    t = f"`{text}`"
    tail = lambda s: f"substring_index({s}, '{PAGE}', -1)"
    # what a gap and a match add: length, newlines, page breaks, newlines after the last page break
    part = lambda s: f"named_struct('n', length({s}), 'nl', {_count(s, LINE)}, 'pg', {_count(s, PAGE)}, 'ln', {_count(tail(s), LINE)})"
    parts = f"transform(m, (v, i) -> named_struct('v', v, 'g', {part('get(g, i)')}, 'm', {part('v')}))"
    then = lambda a, b: f"named_struct('n', {a}.n + {b}.n, 'nl', {a}.nl + {b}.nl, 'pg', {a}.pg + {b}.pg, 'ln', if({b}.pg > 0, 0, {a}.ln) + {b}.ln)"
    zero = "named_struct('n', 0, 'nl', 0, 'pg', 0, 'ln', 0)"
    step = f"transform(array({then('a.t', 'x.g')}), h -> named_struct('t', {then('h', 'x.m')}, 'o', concat(a.o, array(named_struct('s', h.n, 'e', h.n + x.m.n, 'v', x.v, 'nl', h.nl, 'pg', h.pg, 'ln', h.ln)))))[0]"
    chunk = f"aggregate(c, named_struct('t', {zero}, 'o', {EMPTY}), (a, x) -> {step})"
    chunks = f"transform(transform(sequence(0, (size(p) - 1) div {CHUNK}), i -> slice(p, i * {CHUNK} + 1, {CHUNK})), c -> {chunk})"
    bases = f"aggregate(q, named_struct('t', {zero}, 'o', array({zero})), (a, x) -> transform(array({then('a.t', 'x.t')}), h -> named_struct('t', h, 'o', concat(a.o, array(h))))[0], a -> a.o)"
    moved = "named_struct('s', h.s + b.n, 'e', h.e + b.n, 'v', h.v, 'nl', h.nl + b.nl, 'pg', h.pg + b.pg, 'ln', if(h.pg > 0, 0, b.ln) + h.ln)"
    joined = f"flatten(transform(q, (c, i) -> transform(array(get(bs, i)), b -> transform(c.o, h -> {moved}))[0]))"
    p = _literal(pattern)
    body = _let("q", chunks, _let("bs", bases, joined))
    body = _let("m", f"regexp_extract_all({t}, {p}, 0)", f"if(size(m) = 0, {EMPTY}, {_let('g', f'split({t}, {p}, -1)', _let('p', parts, body))})")
    guard = f"{t} is not null" + (f" and {t} rlike {_literal(needs)}" if needs else "")
    return F.expr(f"if({guard}, {body}, {EMPTY})")


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with a name bound to a value that is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def line_label(h: Column) -> Column:
    return F.concat(F.lit("L"), (h["nl"] + 1).cast("string"))


def page_label(h: Column) -> Column:
    return F.concat(F.lit("p."), (h["pg"] + 1).cast("string"), F.lit(" L"), (h["ln"] + 1).cast("string"))


def last_start(starts: Column, offset: Column) -> Column:
    """Index of the last of ascending numbers (array<int>) that is at or before the offset, by binary search; -1 before
    the first."""
    start = F.struct(F.lit(0).alias("lo"), F.size(starts).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        return let(
            F.floor((a["lo"] + a["hi"]) / 2).cast("int"),
            lambda mid: F.when(a["lo"] >= a["hi"], a)
            .when(F.get(starts, mid) <= offset, F.struct((mid + 1).alias("lo"), a["hi"].alias("hi")))
            .otherwise(F.struct(a["lo"].alias("lo"), mid.alias("hi"))),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(starts), F.lit(1)) + 1)).cast("int"))
    return F.aggregate(steps, start, halve, lambda a: a["lo"]) - 1


def cell_label(cells: Column, offset: Column) -> Column:
    """Sheet, column letters and row of the cell that an offset lies in; null before the first. cells: CELLS."""
    from .scalars import column_letters

    return let(
        last_start(cells["start"], offset),
        lambda i: F.when(i >= 0, F.concat(F.get(cells["sheet"], last_start(cells["first"], i)), F.lit("!"), column_letters(F.get(cells["col"], i)), F.get(cells["row"], i).cast("string"))),
    )
