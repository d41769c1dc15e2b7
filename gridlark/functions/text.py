"""Null-tolerant text building, message templates and number formatting."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.functions.conditions import literal


def join_text(*parts: Column) -> Column:
    """Concatenate, reading NULL as the empty string (message semantics)."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def fixed_sql(expr: str, places: int) -> str:
    """``12345.6`` -> ``12345.60``: fixed places, half to even, without thousands separators."""
    return f"translate(format_number(cast({expr} AS double), {places}), ',', '')"


def _field(name: str, spec: str) -> str:
    name, _, fallback = name.partition("|")
    if spec == "whole":
        out = f"cast(cast(round({name}) AS bigint) AS string)"
    elif spec == "trunc":
        out = f"cast(cast({name} AS int) AS string)"
    elif spec == "grouped":
        out = f"format_number({name}, 0)"
    elif spec[:1] == "r":
        out = f"cast(round({name}, {int(spec[1:])}) AS string)"
    elif spec[:1] == "f":
        out = fixed_sql(f"coalesce({name}, 0D)", int(spec[1:]))
    elif spec:
        raise ValueError(f"unknown format {spec!r} for {name!r}")
    else:
        out = f"cast({name} AS string)"
    return f"coalesce({out}, {literal(fallback)})" if fallback else out


def template_sql(pattern: str) -> str:
    parts: list[str] = []
    for text, name, spec, _ in Formatter().parse(pattern):
        if text:
            parts.append(literal(text))
        if name is not None:
            parts.append(_field(name, spec or ""))
    return f"concat_ws('', {', '.join(parts)})"


def template(pattern: str) -> Column:
    """Build a text from ``"text {column|fallback:spec} text"``.

    Specs: none = as text, ``rN`` = rounded to N places, ``fN`` = N fixed places (NULL
    reads as zero), ``whole`` = rounded to an integer, ``trunc`` = cut to an integer,
    ``grouped`` = integer with thousands separators. A NULL without a fallback
    contributes nothing.
    """
    return F.expr(template_sql(pattern))


def padded_index(col: Column, width: int = 3) -> Column:
    """Zero-padded index that grows past ``width`` instead of being cut."""
    return F.format_string(f"%0{width}d", col)
