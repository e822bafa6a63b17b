"""State predicates in a CEL subset, over resources and their neighbours.

Fields have no fixed types, so a predicate is compiled to closures once in each
worker and evaluated on Arrow batches; an error on one resource makes that
resource incomplete and never fails the job.  Neighbours are joined beforehand,
and only for predicates that ask for them.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import cron


class CelError(Exception):
    """A predicate that can't be compiled or evaluated."""


_TOKEN = re.compile(r"""(?P<space>\s+|//[^\n]*)|(?P<str>[rR]?(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'))|(?P<num>0x[0-9a-fA-F]+u?|(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+|u)?)|(?P<id>[A-Za-z_]\w*)|(?P<op>&&|\|\||[=!<>]=|[-+*/%!<>?:.,(){}\[\]])""")
_MACROS = ("all", "exists", "exists_one", "map", "filter")
Env = dict
Node = Callable[[Env], object]


def _same(a, b) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return type(a) is type(b) and a == b
    return a == b if isinstance(a, (int, float)) == isinstance(b, (int, float)) else False


def _ordered(a, b) -> None:
    kinds = [("n" if isinstance(x, (int, float)) and not isinstance(x, bool) else type(x)) for x in (a, b)]
    if kinds[0] != kinds[1] or kinds[0] in (dict, list, type(None)):
        raise CelError("no such overload: comparison")


def _add(a, b):
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, list) and isinstance(b, list):
        return a + b
    return _number(a, b, lambda: a + b)


def _number(a, b, f):
    ok = all(isinstance(x, (int, float, datetime, timedelta)) and not isinstance(x, bool) for x in (a, b))
    if not ok or isinstance(a, (int, float)) and isinstance(b, (int, float)) and isinstance(a, int) != isinstance(b, int):
        raise CelError("no such overload: arithmetic")
    try:
        out = f()
    except (TypeError, OverflowError) as e:
        raise CelError(str(e)) from e
    if isinstance(out, int) and not -(2**63) <= out < 2**64:
        raise CelError("integer overflow")
    return out


def _divide(a, b):
    if isinstance(a, int) and isinstance(b, int):
        if b == 0:
            raise CelError("division by zero")
        return _number(a, b, lambda: abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1))
    if b == 0:
        return math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1, b)
    return _number(a, b, lambda: a / b)


def _remainder(a, b):
    if not isinstance(a, int) or not isinstance(b, int) or b == 0:
        raise CelError("no such overload or modulus by zero")
    return a - b * _divide(a, b)


def _text(x) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)
    if isinstance(x, datetime):
        return x.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S") + (f".{x.microsecond:06d}".rstrip("0") if x.microsecond else "") + "Z"
    if isinstance(x, timedelta):
        return f"{x.total_seconds():g}s"
    if isinstance(x, (str, int)):
        return str(x)
    raise CelError("no such overload: string")


def _int(x) -> int:
    if isinstance(x, datetime):
        return math.floor(x.timestamp())
    try:
        return int(x)
    except (ValueError, TypeError, OverflowError) as e:
        raise CelError(f"not an int: {x!r}") from e


def _double(x) -> float:
    try:
        return float(x)
    except (ValueError, TypeError) as e:
        raise CelError(f"not a double: {x!r}") from e


def _timestamp(x) -> datetime:
    try:
        if isinstance(x, int) and not isinstance(x, bool):
            return datetime.fromtimestamp(x, UTC)
        return x if isinstance(x, datetime) else datetime.fromisoformat(x)
    except (ValueError, TypeError, OverflowError) as e:
        raise CelError(f"not a timestamp: {x!r}") from e


def _duration(x) -> timedelta:
    from tidewell.plans.logql_syntax import parse_duration

    ns = parse_duration(x.lstrip("-")) if isinstance(x, str) else None
    if ns is None:
        raise CelError(f"not a duration: {x!r}")
    return timedelta(microseconds=ns / 1000) * (-1 if x.startswith("-") else 1)


def _size(x) -> int:
    if isinstance(x, (str, list, dict)):
        return len(x)
    raise CelError("no such overload: size")


def lookup(r: dict, path: str, default):
    """Field of a resource: the exact key first, then a dotted path through maps."""
    at = r.get("fields") or {}
    if path in at:
        return at[path]
    for step in path.split("."):
        if not isinstance(at, dict) or step not in at:
            return default
        at = at[step]
    return at


def _cron(spec, zone, at):
    try:
        return cron.previous(spec, zone, at)
    except cron.CronError as e:
        raise CelError(str(e)) from e


FUNCTIONS: dict[str, Callable] = {
    "size": _size, "int": _int, "uint": _int, "double": _double, "string": _text, "timestamp": _timestamp, "duration": _duration, "field": lookup, "cronPrevious": _cron,
    "bool": lambda x: {"true": True, "false": False}.get(x, x) if isinstance(x, (str, bool)) else x, "out": lambda r, t: _near(r, "out", t), "_in": lambda r, t: _near(r, "in", t), "dyn": lambda x: x,
}
METHODS: dict[str, Callable] = {
    "startsWith": str.startswith, "endsWith": str.endswith, "contains": lambda s, x: x in s, "matches": lambda s, x: re.search(x, s) is not None, "split": lambda s, sep, n=-1: s.split(sep) if n < 0 else s.split(sep, n - 1) if n else [],
    "substring": lambda s, a, b=None: s[a:b], "join": lambda x, sep="": sep.join(x), "lowerAscii": str.lower, "upperAscii": str.upper, "replace": lambda s, a, b, n=-1: s.replace(a, b, n), "trim": str.strip, "indexOf": str.find, "lastIndexOf": str.rfind, "charAt": lambda s, i: s[i : i + 1], "size": _size,
    "getFullYear": lambda t: t.year, "getMonth": lambda t: t.month - 1, "getDate": lambda t: t.day, "getDayOfMonth": lambda t: t.day - 1, "getDayOfWeek": lambda t: t.isoweekday() % 7, "getHours": lambda t: t.hour if isinstance(t, datetime) else int(t.total_seconds() // 3600),
    "getMinutes": lambda t: t.minute if isinstance(t, datetime) else int(t.total_seconds() // 60), "getSeconds": lambda t: t.second if isinstance(t, datetime) else int(t.total_seconds()),
}
MATH: dict[str, Callable] = {"greatest": lambda *a: max(a[0] if len(a) == 1 else a), "least": lambda *a: min(a[0] if len(a) == 1 else a), "abs": abs, "ceil": lambda x: float(math.ceil(x)), "floor": lambda x: float(math.floor(x)), "round": lambda x: math.copysign(math.floor(abs(x) + 0.5), x), "sign": lambda x: (x > 0) - (x < 0), "isNaN": math.isnan}


def _near(r: dict, way: str, edge_type: str) -> list:
    return [x for x in r.get(f"\0{way}") or [] if x["\0type"] == edge_type]


def _holds(x) -> bool:
    if not isinstance(x, bool):
        raise CelError("not a bool")
    return x


def _both(a: Node, b: Node, stop: bool) -> Node:
    """&& (stop at false) and || (stop at true): an error counts only if the other side does not decide."""

    def run(env):
        try:
            if _holds(a(env)) is stop:
                return stop
        except CelError:
            if _holds(b(env)) is stop:
                return stop
            raise
        return _holds(b(env))

    return run


class _Parser:
    def __init__(self, text: str):
        self.toks, at, self.nodes = [], 0, 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise CelError(f"cel: unexpected {text[at]!r} at position {at}")
            if m.lastgroup != "space":
                self.toks.append((m.lastgroup, m.group(), at))
            at = m.end()
        self.toks.append(("end", "", at))
        self.i = 0

    def at(self, *ops: str) -> bool:
        kind, text, _ = self.toks[self.i]
        return kind != "str" and text in ops

    def take(self, *ops: str) -> str | None:
        if self.at(*ops):
            self.i += 1
            return self.toks[self.i - 1][1]
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise CelError(f"cel: expected {op!r} at position {self.toks[self.i][2]}")

    def ternary(self) -> Node:
        self.nodes += 1
        test = self.either()
        if not self.take("?"):
            return test
        a = self.either()
        self.need(":")
        b = self.ternary()
        return lambda env: a(env) if _holds(test(env)) else b(env)

    def either(self) -> Node:
        left = self.also()
        while self.take("||"):
            left = _both(left, self.also(), True)
        return left

    def also(self) -> Node:
        left = self.relation()
        while self.take("&&"):
            left = _both(left, self.relation(), False)
        return left

    def relation(self) -> Node:
        left = self.sum()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            left = self._relate(op, left, self.sum())
        return left

    @staticmethod
    def _relate(op: str, a: Node, b: Node) -> Node:
        def run(env):
            x, y = a(env), b(env)
            if op == "in":
                if not isinstance(y, (list, dict)):
                    raise CelError("no such overload: in")
                return any(_same(x, z) for z in y)
            if op in ("==", "!="):
                return _same(x, y) is (op == "==")
            _ordered(x, y)
            return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

        return run

    def sum(self) -> Node:
        left = self.product()
        while op := self.take("+", "-"):
            left = (lambda a, b: lambda env: _add(a(env), b(env)))(left, self.product()) if op == "+" else (lambda a, b: lambda env: (lambda x, y: _number(x, y, lambda: x - y))(a(env), b(env)))(left, self.product())
        return left

    def product(self) -> Node:
        left = self.unary()
        while op := self.take("*", "/", "%"):
            right = self.unary()
            if op == "*":
                left = (lambda a, b: lambda env: (lambda x, y: _number(x, y, lambda: x * y))(a(env), b(env)))(left, right)
            else:
                left = (lambda f, a, b: lambda env: f(a(env), b(env)))(_divide if op == "/" else _remainder, left, right)
        return left

    def unary(self) -> Node:
        if self.take("!"):
            x = self.unary()
            return lambda env: not _holds(x(env))
        if self.take("-"):
            x = self.unary()
            return lambda env: (lambda v: _number(v, v, lambda: -v))(x(env))
        return self.member()

    def args(self, close: str = ")") -> list[Node]:
        out = []
        while not self.at(close):
            out.append(self.ternary())
            if not self.take(","):
                break
        self.need(close)
        return out

    def member(self) -> Node:
        x = self.primary()
        while True:
            if self.take("."):
                kind, name, at = self.toks[self.i]
                if kind != "id":
                    raise CelError(f"cel: expected a name at position {at}")
                self.i += 1
                x = self.method(x, name, at) if self.take("(") else self.select(x, name)
            elif self.take("["):
                key = self.ternary()
                self.need("]")
                x = self.index(x, key)
            else:
                return x

    @staticmethod
    def select(x: Node, name: str) -> Node:
        def run(env):
            at = x(env)
            if not isinstance(at, dict) or name not in at:
                raise CelError(f"no such key: {name}")
            return at[name]

        run.parts = (x, name)
        return run

    @staticmethod
    def index(x: Node, key: Node) -> Node:
        def run(env):
            at, k = x(env), key(env)
            try:
                if isinstance(at, list) and (not isinstance(k, int) or k < 0):
                    raise CelError("index out of range")
                return at[k]
            except (KeyError, IndexError, TypeError) as e:
                raise CelError(f"no such key: {k!r}") from e

        return run

    def method(self, x: Node, name: str, at: int) -> Node:
        self.nodes += 1
        if name in _MACROS:
            return self.macro(x, name)
        args = self.args()
        if getattr(x, "name", None) == "math" and name in MATH:
            f, own = MATH[name], []
        elif name in METHODS:
            f, own = METHODS[name], [x]
        else:
            raise CelError(f"cel: undeclared method {name!r} at position {at}")

        def run(env):
            try:
                return f(*[a(env) for a in [*own, *args]])
            except (TypeError, ValueError, AttributeError, IndexError, re.error) as e:
                raise CelError(f"no such overload: {name}") from e

        return run

    def macro(self, x: Node, name: str) -> Node:
        kind, var, at = self.toks[self.i]
        if kind != "id":
            raise CelError(f"cel: expected a variable at position {at}")
        self.i += 1
        self.need(",")
        body = self.ternary()
        more = self.ternary() if self.take(",") else None
        self.need(")")

        def run(env):
            over = x(env)
            if not isinstance(over, (list, dict)):
                raise CelError(f"no such overload: {name}")
            inner, error, n, out = dict(env), None, 0, []
            for item in over:
                spend(env)
                inner[var] = item
                if name == "map":
                    if more is None or _holds(body(inner)):
                        out.append((more or body)(inner))
                elif name == "filter":
                    if _holds(body(inner)):
                        out.append(item)
                else:
                    try:
                        hit = _holds(body(inner))
                    except CelError as e:
                        if name == "exists_one":
                            raise
                        error = e
                        continue
                    if name == "exists" and hit or name == "all" and not hit:
                        return hit
                    n += hit
            if name in ("map", "filter"):
                return out
            if error:
                raise error
            return n == 1 if name == "exists_one" else name == "all"

        return run

    def primary(self) -> Node:
        kind, text, at = self.toks[self.i]
        self.i += 1
        self.nodes += 1
        if kind == "num":
            value = float(text) if re.search(r"[.eE]", text) and not text.startswith("0x") else int(text.rstrip("u"), 0)
            return lambda env: value
        if kind == "str":
            body = text[2:-1] if text[0] in "rR" else re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], chr(int(m[1][1:], 16)) if len(m[1]) > 1 else m[1]), text[1:-1], flags=re.S)
            return lambda env: body
        if text == "(" and kind == "op":
            x = self.ternary()
            self.need(")")
            return x
        if text == "[" and kind == "op":
            items = self.args("]")
            return lambda env: [i(env) for i in items]
        if text == "{" and kind == "op":
            pairs = []
            while not self.at("}"):
                k = self.ternary()
                self.need(":")
                pairs.append((k, self.ternary()))
                if not self.take(","):
                    break
            self.need("}")
            return lambda env: {k(env): v(env) for k, v in pairs}
        if kind == "id":
            if text in ("true", "false", "null"):
                value = {"true": True, "false": False, "null": None}[text]
                return lambda env: value
            if self.at("(") and text == "has":
                self.i += 1
                x = self.ternary()
                self.need(")")
                if not hasattr(x, "parts"):
                    raise CelError(f"cel: has() needs a selection at position {at}")
                inner, name = x.parts

                def has(env):
                    held = inner(env)
                    if not isinstance(held, dict):
                        raise CelError("no such overload: has")
                    return name in held

                return has
            if self.take("("):
                if text not in FUNCTIONS and text != "in":
                    raise CelError(f"cel: undeclared function {text!r} at position {at}")
                f, args = FUNCTIONS["_in" if text == "in" else text], self.args()

                def call(env):
                    try:
                        return f(*[a(env) for a in args])
                    except (TypeError, ValueError, AttributeError) as e:
                        raise CelError(f"no such overload: {text}") from e

                return call

            def variable(env):
                if text not in env:
                    raise CelError(f"undeclared reference: {text}")
                return env[text]

            variable.name = text
            return variable
        raise CelError(f"cel: unexpected {text or 'end'!r} at position {at}")


def compile_cel(text: str, max_nodes: int = 500) -> Node:
    """A function of an environment with ``r`` and ``now``; raises on what it can't compile."""
    p = _Parser(text)
    x = p.ternary()
    if p.toks[p.i][0] != "end":
        raise CelError(f"cel: unexpected {p.toks[p.i][1]!r} at position {p.toks[p.i][2]}")
    if p.nodes > max_nodes:
        raise CelError(f"cel: complexity {p.nodes} exceeds {max_nodes}")
    return x


def spend(env: Env) -> None:
    """Count a step of a macro; a predicate that takes more than its limit fails on this resource."""
    cost = env.get("\0cost")
    if cost is not None:
        cost[0] -= 1
        if cost[0] < 0:
            raise CelError("cost limit exceeded")


COST = 100_000  # steps of macros that a predicate may take on one resource
OUT = "uid string, kind string, namespace string, name string, holds boolean, error string, labels map<string,string>"


def evaluate(resources: DataFrame, expr: str, now_ms: int, *, kinds: tuple[str, ...], labels: dict[str, str] | None = None, required: tuple[str, ...] = (), edges: DataFrame | None = None, cost: int = COST) -> DataFrame:
    """A predicate on every resource of the kinds: ``uid, kind, namespace, name, holds, error, labels``.

    resources: uid, kind, namespace, name, fields (JSON text).  edges: ``from_uid,
    type, to_uid, attrs``, needed for ``out`` and ``in``.  A missing required
    field or an error gives a null ``holds`` and the error; so does a result that
    is no bool, which the caller takes for a failure of the rule, and a predicate
    whose macros take more than ``cost`` steps.
    """
    compile_cel(expr)
    told = labels or {}
    for v in told.values():
        if v.startswith("="):
            compile_cel(v[1:])
    df = resources.where(F.col("kind").isin(*kinds)).select("uid", "kind", "namespace", "name", "fields")
    text = " ".join([expr, *told.values()])
    for way, uses, a, b in (("out", r"\bout\s*\(", "from_uid", "to_uid"), ("in", r"\bin\s*\(", "to_uid", "from_uid")):
        if edges is not None and re.search(uses, text):
            near = resources.select(F.col("uid").alias(b), "kind", "namespace", "name", "fields").join(edges.select(a, b, "type", "attrs"), b)
            near = near.groupBy(F.col(a).alias("uid")).agg(F.array_sort(F.collect_list(F.struct(F.col(b).alias("uid"), "type", "kind", "namespace", "name", "fields", "attrs"))).alias(way))
            df = df.join(near, "uid", "left")
        else:
            df = df.withColumn(way, F.lit(None).cast("array<struct<uid:string,type:string,kind:string,namespace:string,name:string,fields:string,attrs:string>>"))

    def resource(uid, kind, namespace, name, fields) -> dict:
        return {"uid": uid, "kind": kind, "namespace": namespace or "", "name": name or "", "fields": json.loads(fields) if fields else {}}

    def run(batches):
        predicate, shown = compile_cel(expr), {k: compile_cel(v[1:]) if v.startswith("=") else v for k, v in told.items()}
        now = datetime.fromtimestamp(now_ms / 1000, UTC)
        for pdf in batches:
            out = []
            for uid, kind, namespace, name, fields, outs, ins in pdf[["uid", "kind", "namespace", "name", "fields", "out", "in"]].itertuples(index=False):
                row = [uid, kind, namespace, name, None, None, None]
                try:
                    r = resource(uid, kind, namespace, name, fields)
                    for way, near in (("out", outs), ("in", ins)):
                        r[f"\0{way}"] = [resource(x["uid"], x["kind"], x["namespace"], x["name"], x["fields"]) | {"edge": json.loads(x["attrs"]) if x["attrs"] else {}, "\0type": x["type"]} for x in (near if near is not None else ())]
                    missing = [p for p in required if lookup(r, p, None) is None]
                    if missing:
                        raise CelError(f"missing required field {missing[0]}")
                    env = {"r": r, "now": now, "\0cost": [cost]}
                    row[4] = _holds(predicate(env))
                    if row[4]:
                        row[6] = {k: v for k, v in (("kind", kind), ("namespace", namespace), ("name", name)) if v} | {k: f if isinstance(f, str) else _text(f(env)) for k, f in shown.items()}
                except (CelError, ValueError, RecursionError) as e:
                    row[4], row[5] = None, str(e)
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return df.mapInPandas(run, OUT)
