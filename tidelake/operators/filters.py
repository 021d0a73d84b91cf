"""Filters as (column, operator, values) and their use on columns, partition paths and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError, UnsupportedError

#: A literal that is no value of the type (a bad decimal is an ArithmeticError), or times with and without a zone.
INCOMPARABLE = (TypeError, ValueError, ArithmeticError)
NEGATED = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">", "IN": "NOT IN", "NOT IN": "IN"}


def split_values(text: str) -> list[str]:
    """The values of a list: commas part them, a backslash before a comma or backslash takes it literally; blanks are dropped."""
    out, now, escaped = [], "", False
    for c in text:
        if escaped:
            now += c if c in ",\\" else "\\" + c
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == ",":
            out.append(now)
            now = ""
        else:
            now += c
    out.append(now + "\\" * escaped)
    return [v.strip() for v in out if v.strip()]


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    values: tuple[str, ...]

    @classmethod
    def of(cls, column: str, op: str, value: Any) -> Filter:
        op = " ".join(op.upper().split())
        if op not in NEGATED:
            raise UnsupportedError(f"filter operator {op!r}")
        if op in ("IN", "NOT IN"):
            values = split_values(value) if isinstance(value, str) else list(map(str, value))
            if not values:
                raise UnsupportedError(f"{op} without a value")
        else:
            values = [str(value)]
        return cls(column, op, tuple(values))

    def __invert__(self) -> Filter:
        return Filter(self.column, NEGATED[self.op], self.values)

    def condition(self, kind: T.DataType) -> Column:
        """Values are cast to the column's type; a value that can't be is an error, and a null row fails."""
        col = F.col(".".join(f"`{p}`" for p in self.column.split(".")))
        values = [F.lit(v).cast(kind) for v in self.values]
        if self.op == "IN":
            return reduce(lambda a, b: a | b, (col == v for v in values))
        if self.op == "NOT IN":
            return reduce(lambda a, b: a & b, (col != v for v in values))
        v = values[0]
        return {"=": col == v, "!=": col != v, "<": col < v, "<=": col <= v, ">": col > v, ">=": col >= v}[self.op]

    def may_hold(self, least: Any, most: Any) -> bool:
        """Whether a value between ``least`` and ``most`` can pass; None is unbounded. Lists and unknown types always may."""
        if self.op in ("IN", "NOT IN"):
            return True
        try:
            v = cast_value(self.values[0], type(least if least is not None else most))
            low, high = least is None or least <= v, most is None or v <= most
            return {
                "=": low and high,
                "!=": not (least is not None and least == most == v),
                "<": least is None or least < v,
                "<=": low,
                ">": most is None or most > v,
                ">=": high,
            }[self.op]
        except INCOMPARABLE:
            return True

    def holds(self, value: Any) -> bool:
        """For one known value; True where it can't be compared."""
        try:
            values = [cast_value(v, type(value)) for v in self.values]
            if self.op == "IN":
                return value in values
            if self.op == "NOT IN":
                return value not in values
            v = values[0]
            return {"=": value == v, "!=": value != v, "<": value < v, "<=": value <= v, ">": value > v, ">=": value >= v}[self.op]
        except INCOMPARABLE:
            return True


def cast_value(text: str, kind: type) -> Any:
    import datetime as dt
    from decimal import Decimal

    if kind is bool:
        if text.lower() not in ("true", "false"):
            raise ValueError(text)
        return text.lower() == "true"
    if kind in (int, float, str, Decimal):
        return kind(text)
    if kind is dt.date:
        return dt.date.fromisoformat(text)
    if kind is dt.datetime:
        return dt.datetime.fromisoformat(text)
    raise TypeError(kind)


@dataclass(frozen=True)
class col:  # noqa: N801
    """``col("a").eq(1)`` and so on."""

    name: str

    def eq(self, v: Any) -> Filter:
        return Filter.of(self.name, "=", v)

    def ne(self, v: Any) -> Filter:
        return Filter.of(self.name, "!=", v)

    def lt(self, v: Any) -> Filter:
        return Filter.of(self.name, "<", v)

    def lte(self, v: Any) -> Filter:
        return Filter.of(self.name, "<=", v)

    def gt(self, v: Any) -> Filter:
        return Filter.of(self.name, ">", v)

    def gte(self, v: Any) -> Filter:
        return Filter.of(self.name, ">=", v)

    def in_list(self, values: Sequence) -> Filter:
        return Filter.of(self.name, "IN", values)

    def not_in_list(self, values: Sequence) -> Filter:
        return Filter.of(self.name, "NOT IN", values)


def as_filter(given: Any) -> Filter | Column:
    return given if isinstance(given, Filter | Column) else Filter.of(*given)


def as_filters(given: Sequence) -> list[Filter]:
    return [f for f in map(as_filter, given) if isinstance(f, Filter)]


def field_type(schema: T.StructType, name: str) -> T.DataType:
    kind: T.DataType = schema
    for part in name.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            raise SchemaError(f"no column {name!r}")
        kind = kind[part].dataType
    return kind
