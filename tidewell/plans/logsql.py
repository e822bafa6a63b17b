"""LogQL translated to LogsQL for external log stores, or a named rejection.

The store is expected to keep stream labels as stream fields and the line as
``_msg``; the value of a metric query is the field ``value``, evaluated now.
"""

from __future__ import annotations

import json
import re

from tidewell.plans import logql_syntax as S


class TranslationError(ValueError):
    """A construct without an exact counterpart."""

    def __init__(self, construct: str, reason: str):
        super().__init__(f"logql: cannot translate {construct}: {reason}")
        self.construct = construct


RAW, ROWS = "tidewell.json", "tidewell.rows"


def _q(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def _plain_dot(pattern: str) -> str:
    return _q(f"(?-s:{pattern})")


def _line_filter(f: S.LineFilter) -> str | None:
    if f.op == "|=":
        return f"*{_q(f.value)}*" if f.value else None
    if f.op == "!=":
        return f"!*{_q(f.value)}*" if f.value else '!~".*"'
    return ("~" if f.op == "|~" else "!~") + _plain_dot(f.value)


def _takes_empty(m: S.Matcher) -> bool:
    """Does a matcher accept a stream without its label?"""
    same = m.value == "" if m.op in ("=", "!=") else re.fullmatch(m.value, "") is not None
    return same == (m.op in ("=", "=~"))


class _Labels:
    """Which labels a filter may name at this point of the pipeline."""

    def __init__(self, query: S.LogQuery):
        self.pinned = {m.name for m in query.matchers if not _takes_empty(m)}
        self.parser: str | None = None

    def check(self, name: str) -> str:
        if name == "__error__":
            raise TranslationError("__error__ label filters", "no parser errors are recorded")
        if name.startswith("_") or name == "value":
            raise TranslationError(f"label {name!r}", "the field is reserved")
        if self.parser in ("json", "logfmt") and "_" in name and name not in self.pinned:
            raise TranslationError(f"label {name!r} after {self.parser}", "several fields map to one label")
        return name


def _label_test(t, labels: _Labels) -> str:
    if isinstance(t, S.And):
        return " ".join(f"({_label_test(x, labels)})" if isinstance(x, S.Or) else _label_test(x, labels) for x in (t.left, t.right))
    if isinstance(t, S.Or):
        return f"{_label_test(t.left, labels)} or {_label_test(t.right, labels)}"
    if isinstance(t, S.Numeric):
        raise TranslationError(f"{t.kind} label filters", "values that do not parse are kept with an error")
    name = _q(labels.check(t.name))
    body = f"{name}:={_q(t.value)}" if t.op in ("=", "!=") else f"{name}:~{_q(f'^(?s:{t.value})$')}"
    return body if t.op in ("=", "=~") else f"!{body}"


def _pattern(st: S.PatternStage) -> list[str]:
    """One extraction for the whole pattern, then one for each capture whose literal may be missing."""
    parts = list(st.parts or S.pattern_parts(st.text))
    lead = parts[0][1] if parts[0][0] == "literal" else ""
    guard = f" if (_msg:={_q(lead)}*)" if lead else ""
    unnamed, out = 0, []

    def shown(kind: str, text: str) -> str:
        nonlocal unnamed
        if kind == "literal":
            return text
        if text == "_":
            unnamed += 1
            return f"<plain:tidewell.skip{unnamed}>"
        return f"<plain:{text}>"

    for kind, name in parts:
        if kind == "capture" and name.startswith("_") and name != "_":
            raise TranslationError(f"pattern capture {name!r}", "the field is reserved")
    out.append(f"extract{guard} {_q(''.join(shown(k, t) for k, t in parts))} from _msg keep_original_fields")
    for k, (kind, name) in enumerate(parts):
        if kind == "capture" and name != "_" and k + 1 < len(parts):
            unnamed = 0
            prefix = "".join(shown(a, b) for a, b in parts[: k + 1])
            missing = f"if ({_q(name)}:=\"\"{f' _msg:={_q(lead)}*' if lead else ''})"
            out.append(f"extract {missing} {_q(prefix)} from _msg keep_original_fields")
    skipped = sum(1 for k, t in parts if k == "capture" and t == "_")
    if skipped:
        out.append("delete " + ", ".join(f"tidewell.skip{i}" for i in range(1, skipped + 1)))
    return out


def _pipeline(q: S.LogQuery) -> tuple[str, list[str], _Labels]:
    """(filter, pipes, labels)."""
    labels = _Labels(q)
    stream = "_stream:{" + ",".join(f"{_q(m.name)}{m.op}{_q(m.value)}" for m in q.matchers) + "}"
    filters, pipes = [stream], []
    for st in q.stages:
        if isinstance(st, S.LineFilter):
            text = _line_filter(st)
            if text and pipes:
                pipes.append(f"filter {text}")
            elif text:
                filters.append(text)
        elif isinstance(st, S.LabelFilter):
            text = _label_test(st.test, labels)
            if pipes:
                pipes.append(f"filter {text}")
            else:
                filters.append(f"({text})" if isinstance(st.test, S.Or) else text)
        else:
            name = type(st).__name__.removesuffix("Stage").lower()
            if labels.parser:
                raise TranslationError("a second parser stage", "chained parsers overwrite labels in another way")
            labels.parser = name
            if isinstance(st, S.JsonStage):
                if st.paths:
                    raise TranslationError("json extraction parameters", "paths can't be extracted into renamed fields")
                pipes += [f'copy _msg as "{RAW}"', f'replace_regexp ("^[ \\t\\r\\n]+", "") at "{RAW}"', f'unpack_json from "{RAW}" keep_original_fields', f'delete "{RAW}"']
            elif isinstance(st, S.LogfmtStage):
                pipes.append("unpack_logfmt keep_original_fields")
            elif isinstance(st, S.PatternStage):
                pipes += _pattern(st)
            else:
                for name in re.findall(r"\(\?P?<(_\w*)>", st.text):
                    raise TranslationError(f"regexp capture {name!r}", "the field is reserved")
                pipes.append(f"extract_regexp {_plain_dot(st.text)} keep_original_fields")
    return " ".join(filters), pipes, labels


def _fold(x) -> float:
    if isinstance(x, S.Scalar):
        return x.value
    a, b = _fold(x.left), _fold(x.right)
    if x.op not in "+-*/" or x.op == "/" and b == 0:
        raise TranslationError(f"operator {x.op}", "no verified counterpart")
    return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else 0}[x.op]


def _range(x: S.RangeAgg, by: tuple[str, ...] | None, summed: bool) -> tuple[str, list[str]]:
    text, pipes, labels = _pipeline(x.query)
    if labels.parser and not summed:
        raise TranslationError("a range aggregation with a parser and no enclosing sum", "series identity has every extracted label")
    names = [_q(labels.check(n)) for n in by or ()]
    count = "sum_len(_msg)" if x.op == "bytes_over_time" else "count()"
    keys = names if summed else ["_stream", *names]
    if keys:
        stats = [f"stats by ({', '.join(keys)}) {count} as value"]
    else:  # without any line there is no sample
        stats = [f'stats count() as "{ROWS}", {count} as value', f'filter "{ROWS}":>0', f'delete "{ROWS}"']
    if x.op == "rate":
        stats.append(f"math (value / {S.show_number(x.range_ns / 1e9)}) as value")
    return f"_time:(now-{S.show_duration(x.range_ns)},now] {text}", [*pipes, *stats]


def _metric(x) -> tuple[str, list[str]]:
    if isinstance(x, S.RangeAgg):
        return _range(x, None, False)
    if isinstance(x, S.VectorAgg):
        if x.op == "topk":
            raise TranslationError("topk", "no top-k with the same ties")
        if x.without:
            raise TranslationError("without grouping", "groups are by listed fields only")
        if isinstance(x.arg, S.RangeAgg) and x.op == "sum":
            return _range(x.arg, x.by, True)
        text, pipes = _range(x.arg, x.by, False) if isinstance(x.arg, S.RangeAgg) else _metric(x.arg)
        how = "count()" if x.op == "count" else f"{x.op}(value)"
        if x.by:
            return text, [*pipes, f"stats by ({', '.join(map(_q, x.by))}) {how} as value"]
        return text, [*pipes, f'stats count() as "{ROWS}", {how} as value', f'filter "{ROWS}":>0', f'delete "{ROWS}"']
    if x.bool_:
        raise TranslationError("bool", "filters drop rows")
    left_scalar = S.is_scalar(x.left)
    text, pipes = _metric(x.right if left_scalar else x.left)
    n = _fold(x.left if left_scalar else x.right)
    shown = S.show_number(n)
    if x.op in S.COMPARISONS:
        op = {">": "<", "<": ">", ">=": "<=", "<=": ">="}.get(x.op, x.op) if left_scalar else x.op
        if op in ("==", "!="):
            both = f"value:>={shown} value:<={shown}"
            return text, [*pipes, f"filter {both}" if op == "==" else f"filter !({both})"]
        return text, [*pipes, f"filter value:{op}{shown}"]
    if x.op not in "+-*/" or x.op == "/" and (left_scalar or n == 0):
        raise TranslationError(f"operator {x.op}", "no verified counterpart")
    return text, [*pipes, f"math ({shown} {x.op} value) as value" if left_scalar else f"math (value {x.op} {shown}) as value"]


def to_logsql(text: str) -> str:
    """The LogsQL query that means the same."""
    x = S.parse(text)
    if isinstance(x, S.LogQuery):
        head, pipes, _ = _pipeline(x)
    else:
        head, pipes = _metric(x)
    return " | ".join([head, *pipes])


def inject_scope(query: str, matchers: list[S.Matcher]) -> str:
    """A native LogsQL query narrowed to streams: the scope is joined to its filter by AND, ahead of its pipes."""
    depth, quote, cut, i = 0, "", len(query), 0
    while i < len(query):
        c = query[i]
        if quote:
            if c == "\\" and quote != "`":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0 and not re.search(r"[\[(][^\[\]()]*$", query[:i]):
                raise TranslationError("an unbalanced query", "it can't be scoped")
            depth = max(depth, 0)
        elif c == "|" and not depth:
            cut = i
            break
        i += 1
    if quote or depth:
        raise TranslationError("an unbalanced query", "it can't be scoped")
    head, rest = query[:cut].strip(), query[cut:]
    scope = "_stream:{" + ",".join(f"{_q(m.name)}{m.op}{_q(m.value)}" for m in matchers) + "}"
    return f"{scope} ({head or '*'}){' ' + rest if rest else ''}" if matchers else query
