"""Columns over label maps: canonical keys, projections, matchers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.plans.logql_syntax import check_re2


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def value_of(labels: Column, name: str) -> Column:
    """Label value; an absent label is the empty string."""
    return F.coalesce(F.element_at(labels, F.lit(name)), F.lit(""))


def canonical(labels: Column) -> Column:
    """``{a="x", b="y"}`` in order of the names: a key that sorts and groups."""
    entries = F.array_sort(F.map_entries(labels))
    shown = F.transform(entries, lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}"))


def keep(labels: Column, names: tuple[str, ...]) -> Column:
    if not names:
        return empty_map()
    return F.map_filter(labels, lambda k, _: k.isin(*names))


def drop(labels: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(*names)) if names else labels


def project(labels: Column, by: tuple[str, ...] | None, without: bool) -> Column:
    """Labels of the group: of ``by``, all but those of ``without``, or none."""
    if by is None:
        return empty_map()
    return drop(labels, by) if without else keep(labels, by)


def anchored(pattern: str) -> str:
    """A pattern that matches the whole value, in which the dot matches newlines."""
    return rf"\A(?s:{check_re2(pattern)})\z"


def matches(value: Column, op: str, text: str) -> Column:
    """Matcher on a label value (absent is empty)."""
    if op == "=":
        return value == text
    if op == "!=":
        return value != text
    hit = value.rlike(anchored(text))
    return hit if op == "=~" else ~hit
