"""Text functions with PostgreSQL's rules for nulls, booleans, padding and quoting."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship


def bool_text(x: Column) -> Column:
    """t or f, as boolean output functions give them."""
    return F.when(x, "t").when(~x, "f")


def _as_text(x: Column, boolean: bool) -> Column:
    return bool_text(x) if boolean else x.cast("string")


def concat(*parts: Column, booleans: tuple[int, ...] = ()) -> Column:
    """concat(): nulls count as empty; `booleans` are the places of boolean arguments."""
    return F.concat_ws("", *(_as_text(p, i in booleans) for i, p in enumerate(parts)))


def concat_ws(separator: str, *parts: Column, booleans: tuple[int, ...] = ()) -> Column:
    """concat_ws(): null arguments and their separators are left out."""
    return F.concat_ws(separator, *(_as_text(p, i in booleans) for i, p in enumerate(parts)))


def varchar(x: Column, n: int) -> Column:
    """An explicit cast to varchar(n): cut after n characters."""
    return F.substring(x.cast("string"), 1, n)


def bpchar(x: Column, n: int) -> Column:
    """An explicit cast to char(n): cut or filled up with blanks to n characters."""
    return F.rpad(F.substring(x.cast("string"), 1, n), n, " ")


def bpchar_key(x: Column) -> Column:
    """What char(n) values are compared, joined and grouped by: no trailing blanks."""
    return F.rtrim(x)


def bpchar_length(x: Column) -> Column:
    return F.char_length(F.rtrim(x))


def quote_literal(x: Column) -> Column:
    """A text as a SQL literal: quotes and backslashes doubled, with E in front if there is a backslash."""
    doubled = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.concat(F.when(F.contains(x, F.lit("\\")), "E").otherwise(""), F.lit("'"), doubled, F.lit("'"))


def quote_ident(x: Column) -> Column:
    """A text as a SQL identifier: bare if of lower-case letters, digits and underscores without a digit in front."""
    return F.when(x.rlike("^[_a-z][_a-z0-9]*$"), x).otherwise(F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')))


@dataclass(frozen=True)
class Spec:
    """One conversion of a format string; a width is a number, ("next",) or ("at", n)."""

    kind: str
    position: int | None = None
    left: bool = False
    width: int | tuple | None = None


_SPEC = re.compile(r"%(?:(?P<pos>\d+)\$)?(?P<flags>-*)(?:(?P<width>\d+)|\*(?:(?P<at>\d+)\$)?(?P<star>(?<=[*$])))?(?P<kind>.)?", re.S)


def parse_format(pattern: str) -> list[str | Spec]:
    """Literal pieces and conversions of a format string."""
    out: list[str | Spec] = []
    at = 0
    for m in _SPEC.finditer(pattern):
        if m.start() < at:
            continue
        out.append(pattern[at : m.start()])
        at = m.end()
        kind = m["kind"]
        if kind is None:
            raise ValueError("unterminated format() type specifier")
        if kind == "%" and m.group(0) == "%%":
            out.append("%")
            continue
        if kind not in "sIL":
            raise ValueError(f'unrecognized format() type specifier "{kind}"')
        if m["pos"] == "0" or m["at"] == "0":
            raise ValueError("format specifies argument 0, but arguments are numbered from 1")
        width = int(m["width"]) if m["width"] else ("at", int(m["at"])) if m["at"] else ("next",) if m["star"] is not None else None
        out.append(Spec(kind, int(m["pos"]) if m["pos"] else None, bool(m["flags"]), width))
    out.append(pattern[at:])
    return [x for x in out if x != ""]


def resolved(pieces: list[str | Spec], count: int) -> list[tuple[str | Spec, int | None, int | None]]:
    """Each piece with the places of its value and of its width among the arguments, from 0."""
    after, out = 0, []

    def take(position: int | None) -> int:
        nonlocal after
        after = position if position is not None else after + 1
        if after > count:
            raise ValueError("too few arguments for format()")
        return after - 1

    for piece in pieces:
        if isinstance(piece, str):
            out.append((piece, None, None))
            continue
        width = None
        if isinstance(piece.width, tuple):
            width = take(piece.width[1] if piece.width[0] == "at" else None)
        out.append((piece, take(piece.position), width))
    return out


def format(pattern: str, *args: Column, booleans: tuple[int, ...] = ()) -> Column:
    """format() with a constant pattern, parsed once and built of native expressions: %s %I %L %%, n$, -, widths, * and *n$."""
    parts = []
    for piece, at, width_at in resolved(parse_format(pattern), len(args)):
        if isinstance(piece, str):
            parts.append(F.lit(piece))
            continue
        text = _as_text(args[at], at in booleans)
        if piece.kind == "s":
            value = F.coalesce(text, F.lit(""))
        elif piece.kind == "L":
            value = F.coalesce(quote_literal(text), F.lit("NULL"))
        else:
            value = F.when(text.isNull(), F.raise_error(F.lit("null values cannot be formatted as an SQL identifier"))).otherwise(quote_ident(text))
        if piece.width is not None:
            width = F.coalesce(args[width_at].cast("int"), F.lit(0)) if width_at is not None else F.lit(piece.width)
            left = F.lit(True) if piece.left else width < 0
            room = F.greatest(F.abs(width), F.char_length(value))
            value = F.when(left, F.rpad(value, room, F.lit(" "))).otherwise(F.lpad(value, room, F.lit(" ")))
        parts.append(value)
    return F.concat(*parts) if parts else F.lit("")


def format_text(pattern: str, args: list[str | None]) -> str:
    """format() of plain values."""
    out = []
    for piece, at, width_at in resolved(parse_format(pattern), len(args)):
        if isinstance(piece, str):
            out.append(piece)
            continue
        value = args[at]
        if piece.kind == "s":
            text = value or ""
        elif piece.kind == "L":
            text = "NULL" if value is None else ("E" if "\\" in value else "") + "'" + value.replace("\\", "\\\\").replace("'", "''") + "'"
        elif value is None:
            raise ValueError("null values cannot be formatted as an SQL identifier")
        else:
            text = value if re.fullmatch("[_a-z][_a-z0-9]*", value) else '"' + value.replace('"', '""') + '"'
        if piece.width is not None:
            width = int(args[width_at] or 0) if width_at is not None else piece.width
            text = text.ljust(abs(width)) if piece.left or width < 0 else text.rjust(width)
        out.append(text)
    return "".join(out)


def format_dynamic(pattern: Column, *args: Column, booleans: tuple[int, ...] = ()) -> Column:
    """format() with a pattern per row, in Arrow batches; a null pattern gives null."""

    ship(SparkSession.active())

    @F.pandas_udf(T.StringType())
    def apply(patterns: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else format_text(p, list(v)) for p, v in zip(patterns, values, strict=True)])

    return apply(pattern, F.array(*(_as_text(a, i in booleans) for i, a in enumerate(args))) if args else F.array().cast("array<string>"))
