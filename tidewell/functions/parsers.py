"""Log line parsers that extract labels: Arrow functions for JSON and logfmt, plain columns for patterns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.plans.logql_syntax import JsonStage, json_path

LABELS = T.MapType(T.StringType(), T.StringType())
JSON_ERROR = "JSONParserErr"
_BAD = re.compile(r"[^a-zA-Z0-9_]")


class _Number(str):
    """A number as it is written."""


def _numbers() -> json.JSONDecoder:
    def refuse(_):
        raise ValueError("not JSON")

    return json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=refuse, strict=True)


def _name(key: str, top: bool) -> str:
    key = _BAD.sub("_", key.strip())
    return f"_{key}" if top and key[:1].isdigit() else key


def _clean(text: str) -> str:
    return text.replace("�", "").encode("utf-8", "ignore").decode()


def flatten(value: dict, prefix: str = "") -> dict[str, str]:
    """Strings, numbers and booleans of an object; keys of nested objects joined by ``_``."""
    out = {}
    for k, v in value.items():
        key = _name(k, not prefix)
        if not key:
            continue
        key = f"{prefix}_{key}" if prefix else key
        if isinstance(v, dict):
            out.update(flatten(v, key))
        elif isinstance(v, bool):
            out[key] = "true" if v else "false"
        elif isinstance(v, str):
            out[key] = str(v) if isinstance(v, _Number) else _clean(v)
    return out


@F.pandas_udf(LABELS)
def json_labels(lines: pd.Series) -> pd.Series:
    """Labels of a JSON line; null if it is no JSON object."""
    decode = _numbers().decode

    def one(line):
        try:
            value = decode(line)
        except (ValueError, RecursionError):
            return None
        return flatten(value) if isinstance(value, dict) else None

    return lines.map(one, na_action="ignore")


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return str(value)

    def show(v):
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{show(x)}" for k, x in v.items()) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(show, v)) + "]"
        return str(v) if isinstance(v, _Number) else json.dumps(v, ensure_ascii=False)

    return show(value)


def json_paths(stage: JsonStage):
    """Function that yields the labels of a JSON line by path; null if it is no JSON."""
    steps = [(name, json_path(path)) for name, path in stage.paths]

    @F.pandas_udf(LABELS)
    def extract(lines: pd.Series) -> pd.Series:
        decode = _numbers().decode

        def one(line):
            if not line:
                return {}
            if line[0] not in '{["':
                return None
            try:
                value = decode(line)
            except (ValueError, RecursionError):
                return None
            out = {}
            for name, way in steps:
                at = value
                for step in way:
                    if isinstance(step, int):
                        at = at[step] if isinstance(at, list) and step < len(at) else None
                    else:
                        at = at.get(step) if isinstance(at, dict) else None
                out[name] = _text(at)
            return out

        return lines.map(one, na_action="ignore")

    return extract


_QUOTED = re.compile(r'"((?:\\.|[^"\\])*)"', re.S)


def logfmt(line: str) -> dict[str, str]:
    """Pairs of a line; malformed ones are skipped."""
    out: dict[str, str] = {}
    at, n = 0, len(line)
    while at < n:
        if line[at] <= " ":
            at += 1
            continue
        start = at
        while at < n and line[at] > " " and line[at] not in '="':
            at += 1
        key = line[start:at]
        if at >= n or line[at] <= " ":
            continue  # a bare key
        good = bool(key) and line[at] == "="
        if good:
            at += 1
            if at < n and line[at] == '"':
                m = _QUOTED.match(line, at)
                if not m:
                    break  # an unterminated quote ends the line
                at = m.end()
                try:
                    value = json.loads(f'"{m[1]}"', strict=False)
                except ValueError:
                    continue
            else:
                start = at
                while at < n and line[at] > " " and line[at] not in '="':
                    at += 1
                value = line[start:at]
                good = at >= n or line[at] <= " "
        if good:
            name = _name(key, True)
            if name and value:
                out[name] = _clean(value)
        else:
            while at < n and line[at] > " ":
                at += 1
    return out


@F.pandas_udf(LABELS)
def logfmt_labels(lines: pd.Series) -> pd.Series:
    return lines.map(logfmt, na_action="ignore")


def pattern_labels(line: Column, parts: tuple[tuple[str, str], ...]) -> Column:
    """Labels by literals and captures, by one regular expression of nested options.

    Each capture ends at the first occurrence of the literal after it; if that is
    missing it takes the rest, and what follows is not set.
    """
    lead, rest = ("", list(parts)) if parts[0][0] == "capture" else (parts[0][1], list(parts[1:]))
    steps = [(name, rest[k + 1][1] if k + 1 < len(rest) else None) for k, (kind, name) in enumerate(rest) if kind == "capture"]

    def quoted(text: str) -> str:
        return "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in text)

    regex = ""
    for _, literal in reversed(steps):
        regex = "(.*)()" if literal is None else f"(.*?)(?:({quoted(literal)}){regex}|\\z)"
    regex = rf"(?s)\A{quoted(lead)}{regex}"
    pairs = []
    for k, (name, _) in enumerate(steps):
        if name != "_":  # set if the literal before it was there
            there = F.lit(True) if k == 0 else F.regexp_extract(line, regex, 2 * k) != ""
            pairs.append(F.when(there, F.struct(F.lit(name).alias("k"), F.regexp_extract(line, regex, 2 * k + 1).alias("v"))))
    return F.when(line.rlike(regex), F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()))).otherwise(F.create_map().cast("map<string,string>"))


def regexp_labels(line: Column, pattern: str, java: str) -> Column:
    """Labels of the named groups; a line that does not match yields none, a group that takes no part the empty text."""
    groups, depth = [], 0
    bare = re.sub(r"\[(?:\\.|[^\]\\])*\]", lambda m: "x" * len(m[0]), re.sub(r"\\.", "xx", pattern, flags=re.S))
    for m in re.finditer(r"\((\?P?<([^>=!]+)>|\?)?", bare):
        if m[1] == "?":
            continue
        depth += 1
        if m[2]:
            groups.append((depth, pattern[m.start(2) : m.end(2)]))
    made = F.create_map(*[x for i, name in groups for x in (F.lit(name), F.regexp_extract(line, java, i))])
    return F.when(line.rlike(java), made).otherwise(F.create_map().cast("map<string,string>"))
