"""Rows of container logs to whole entries with time, level, component, message.

Templates are mined first.  Every row is tokenised into typed tokens; each
partition clusters its token sequences by longest common subsequence, constant
tokens stay and the gaps become slots; the templates of the partitions are then
merged by the same rule.  Slots are classified by type (timestamp, level,
component, number...).  The head of a template - its leading structural tokens,
as far as the first timestamp, level and component go - is the header of a
layout if it leads in at least one file.  Keys of JSON and key=value lines get
their roles by the types of their values.

Entries are then cut in one pass over range partitions sorted by (source,
stream, seq), so that a hot file is spread over many tasks.  What lies at the
border of two partitions is cut again from its raw rows.
"""

from __future__ import annotations

import calendar
import json
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: spellings of the levels, numeric levels, months -----------
LEVELS = {
    "trace": "trace", "trc": "trace", "trac": "trace", "verbose": "trace", "finest": "trace", "finer": "trace",
    "debug": "debug", "dbg": "debug", "deb": "debug", "fine": "debug",
    "info": "info", "inf": "info", "information": "info", "informational": "info", "notice": "info", "note": "info",
    "warn": "warn", "warning": "warn", "wrn": "warn",
    "error": "error", "err": "error", "eror": "error", "severe": "error",
    "fatal": "fatal", "ftl": "fatal", "critical": "fatal", "crit": "fatal", "crt": "fatal", "panic": "fatal", "alert": "fatal", "emerg": "fatal", "emergency": "fatal",
}
LETTERS = {"T": "trace", "V": "trace", "D": "debug", "I": "info", "N": "info", "W": "warn", "E": "error", "F": "fatal", "C": "fatal", "P": "fatal"}
NUMBERS = {10: "trace", 20: "debug", 30: "info", 40: "warn", 50: "error", 60: "fatal"}
SYSLOG = {0: "fatal", 1: "fatal", 2: "fatal", 3: "error", 4: "warn", 5: "info", 6: "info", 7: "debug"}
MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}
YEAR = 2026  # of timestamps without one
# -----------------------------------------------------------------------------

_ZONE = r"(?: ?(?:Z|UTC|GMT)\b| ?[+-]\d{2}:?\d{2}\b)?"
_MON = "|".join(MONTHS)
STAMPS = rf"\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?{_ZONE}|\d{{4}}/\d\d/\d\d \d\d:\d\d:\d\d(?:\.\d+)?{_ZONE}|\d\d/(?:{_MON})/\d{{4}}:\d\d:\d\d:\d\d(?: [+-]\d{{4}})?|\b(?:{_MON}) [ \d]\d \d\d:\d\d:\d\d"
EPOCHS = r"\b\d{10}\.\d+\b|\b1\d{12}\b|\b1\d{9}\b"
WORDS = "|".join(sorted(LEVELS, key=lambda w: (-len(w), w)))
TYPES = {
    "T": STAMPS,
    "K": r"^[A-Z]\d{4} \d\d:\d\d:\d\d\.\d+",
    "P": r"^<\d{1,3}>",
    "A": r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    "E": EPOCHS,
    "I": r"\b[A-Za-z_][\w-]*(?:\.[A-Za-z_][\w-]*)+",
    "L": rf"(?i:\b(?:{WORDS})\b)(?![.=-])",
    "H": r"\b[A-Za-z][\w.]*(?:-\w+)*-\d+\b",
    "X": r"\b\w*\d\w*\b",
    "W": r"[^\W\d]\w*",
    "S": r" +",
    "C": r"[^\w ]",
}
# a word is matched whole and typed once; the other types are matched in place
TOKEN = re.compile("|".join(f"(?P<{k}>{v})" for k, v in ({k: TYPES[k] for k in "TKPAE"} | {"W": r"[^\W\d][\w.-]*\w|[^\W\d]", "X": TYPES["X"], "S": TYPES["S"], "C": TYPES["C"]}).items()))
VARIES = re.compile(r"[\w-]*\d\w*")
ANSI = re.compile(r"\x1b\[[0-9;]*m")
PAIR = re.compile(r'([A-Za-z_@][\w.@-]*)=("(?:\\.|[^"\\])*"|[^\s"]*)(?:\s+|$)')
PAIRS = re.compile(rf"(?:{PAIR.pattern})+$")
JSON_ROW = re.compile(r'^\s*"((?:\\.|[^"\\])*)"\s*:\s*(.+?),?\s*$')
JSON_START = re.compile(r'\{\s*(?:"|$|\})')
IS_STAMP, IS_EPOCH, IS_NAME = re.compile(f"(?:{STAMPS})"), re.compile(rf"(?:{EPOCHS})"), re.compile(TYPES["I"])
SLOT, SPACE, SEP = "*", " ", "\x1f"
KEYED = frozenset("TEKPLI")
# A head is a layout's header if it has SHARE of the headed rows of some file, or LEAD of those (at least FEW) of some
# stretch of BLOCK numbers of a file, so that a layout to which a file changes late is found.  On the test tables every
# layout that was written is found (recall 1); `layouts` gives them exactly where that does not do.
SHARE, LEAD, FEW, BLOCK = 0.2, 0.5, 8, 64
# A key of JSON or key=value lines has a role if it is in RARE of the rows of its file's commonest key at least, and
# MOSTLY of its values are of the role's type.
RARE, MOSTLY = 0.001, 0.9
CACHED = 200_000  # texts whose template a task remembers
# Rows of an entry, or of what goes on from the partition before, that are held one by one where no message is wanted;
# later ones are held as one row with the last number.  An open JSON object is always held whole; only one that goes on
# for more than HELD rows beyond a border of two partitions loses its fields.
HELD = 2_000


@lru_cache(maxsize=65_536)
def _word(text: str) -> str:
    low = text.lower()
    if low in LEVELS:
        return "<L>"
    if IS_NAME.fullmatch(text):
        return "<I>"
    return low if not any(c.isdigit() for c in text) else "<H>" if "-" in text else "<X>"


def tokens_of(line: str) -> tuple[str, ...]:
    """Typed tokens: words and punctuation stand for themselves, other tokens for their type."""
    out = []
    for m in TOKEN.finditer(line):
        kind = m.lastgroup
        out.append(_word(m.group()) if kind == "W" else m.group() if kind == "C" else SPACE if kind == "S" else f"<{kind}>")
    return tuple(out)


def _lcs_length(a: tuple[str, ...], masks: dict[str, int], n: int) -> int:
    """Length of the longest common subsequence, bit-parallel; masks: positions of each token in the other sequence."""
    full = (1 << n) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def lcs_template(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    """Their longest common subsequence, with a slot wherever either has something between."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, under = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = under[j + 1] + 1 if a[i] == b[j] else max(under[j], row[j + 1])
    out: list[str] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(a[i])
            i, j = i + 1, j + 1
        else:
            if not out or out[-1] != SLOT:
                out.append(SLOT)
            if j >= m or i < n and best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return tuple(out)


class Miner:
    """Clusters token sequences by longest common subsequence."""

    def __init__(self, alike: float = 0.6):
        self.alike = alike
        self.templates: list[tuple[str, ...]] = []
        self.masks: list[dict[str, int]] = []
        self.buckets: dict[str, list[int]] = {}
        self.cache: dict[tuple[str, ...], int] = {}

    def _mask(self, template: tuple[str, ...]) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, x in enumerate(template):
            if x != SLOT:
                out[x] = out.get(x, 0) | 1 << i
        return out

    def add(self, seq: tuple[str, ...]) -> int:
        """The number of the template that ``seq`` belongs to."""
        got = self.cache.get(seq)
        if got is not None:
            return got
        # templates are compared if their leading structure is the same
        key = bucket_of(seq)
        best, at = 0, -1
        for k in self.buckets.setdefault(key, []):
            t = self.templates[k]
            if min(len(t), len(seq)) < self.alike * max(len(t), len(seq)):
                continue
            common = _lcs_length(seq, self.masks[k], len(t))
            if common > best:
                best, at = common, k
                if common == len(seq):
                    break
        if at < 0 or best < self.alike * max(len(seq), len(self.templates[at])):
            at = len(self.templates)
            self.templates.append(seq)
            self.masks.append(self._mask(seq))
            self.buckets[key].append(at)
        elif best < sum(m.bit_count() for m in self.masks[at].values()):  # else the constants stay as they are
            merged = lcs_template(self.templates[at], seq)
            self.templates[at], self.masks[at] = merged, self._mask(merged)
        if len(self.cache) >= CACHED:
            self.cache.clear()
        self.cache[seq] = at
        return at


def head_of(template: tuple[str, ...]) -> str:
    """The leading structural tokens up to the first timestamp, level and component; empty if there is none."""
    depth, seen, end = 0, set(), 0
    for i, x in enumerate(template):
        if x in "[(":
            depth += 1
        elif x in "])":
            depth = max(0, depth - 1)
        elif x == '"' or not depth and (x == SLOT or x[0].isalpha()):
            break
        if len(x) == 3 and x[0] == "<" and x[1] in KEYED:
            role = "T" if x[1] in "TE" else x[1]
            if role in seen:
                break
            seen |= {"K": {"K", "T", "L"}, "P": {"P", "L"}}.get(role, {role})
            end = i + 1
    if not seen & {"T", "L"} or template[0] == SPACE or template[0][0].isspace():
        return ""
    while end < len(template) and len(template[end]) == 1 and template[end] not in "*\"[(" and not template[end].isalnum():
        end += 1
    head, out, depth = template[:end], [], 0
    for x in head:  # what stands in brackets beside the keyed slots is a slot of its own
        if x in "[(":
            depth += 1
        elif x in "])":
            depth = max(0, depth - 1)
        keyed = len(x) == 3 and x[0] == "<" and x[1] in KEYED
        if depth and x not in "[(" and not keyed:
            if out[-1] != SLOT:
                out.append(SLOT)
        else:
            out.append(x)
    return SEP.join(out)


def bucket_of(seq: tuple[str, ...]) -> str:
    """What two templates must have in common to be compared."""
    return head_of(seq) or SEP.join(seq[:2])


def head_pattern(head: str) -> str:
    """Regular expression of a head: named groups for stamp, level and component."""
    groups = {"T": f"(?P<T>{STAMPS})", "E": f"(?P<E>{EPOCHS})", "K": r"(?P<K>[A-Z])(?P<KT>\d{4} \d\d:\d\d:\d\d\.\d+)", "P": r"<(?P<P>\d{1,3})>", "L": rf"(?P<L>(?i:{WORDS}))\b", "I": rf"(?P<I>{TYPES['I']})"}
    out = []
    for x in head.split(SEP):
        if len(x) == 3 and x[0] == "<":
            out.append(groups.get(x[1]) or f"(?:{TYPES[x[1]].lstrip('^')})")
        else:
            out.append({SLOT: r"[^\[\]()]*", SPACE: " +"}.get(x) or re.escape(x))
    return "".join(out)


def _kind_of(value) -> str:
    """Type of a value of a JSON or key=value line."""
    if isinstance(value, bool) or value is None:
        return "-"
    if isinstance(value, (int, float)):
        return "T" if value > 1e9 else "N" if value in NUMBERS else "-"
    if not isinstance(value, str):
        return "-"
    if value.lower() in LEVELS:
        return "L"
    if IS_STAMP.fullmatch(value):
        return "T"
    if value.isdigit() and int(value) in NUMBERS:
        return "N"
    if IS_EPOCH.fullmatch(value):
        return "T"
    return "I" if IS_NAME.fullmatch(value) else "M" if " " in value else "-"


def _unquote(value: str) -> str:
    if value[:1] != '"':
        return value
    try:
        return json.loads(value)
    except ValueError:
        return value[1:-1]


_MINED = "kind string, a string, block long, bucket string, b string, n long"


def _mine(batches):
    """Counts of one partition: (kind, file, stretch of the file, bucket, template or key, n)."""
    miner, per, keys = Miner(), Counter(), Counter()
    known: dict[str, int] = {}  # rows that differ only in tokens with digits are tokenised once
    for batch in batches:
        for source, seq, log in zip(*(batch.column(i).to_pylist() for i in range(3))):
            line = log.rstrip("\r\n")
            if "\x1b" in line:
                line = ANSI.sub("", line)
            if not line:
                continue
            first = line[0]
            if first == "{" and JSON_START.match(line):
                per[source, seq // BLOCK, -1] += 1
                try:
                    pairs = json.loads(line)
                    pairs = pairs.items() if isinstance(pairs, dict) else ()
                except ValueError:
                    pairs = ()
                for k, v in pairs:
                    keys[source, "json", k, _kind_of(v)] += 1
            elif first == " " and (m := JSON_ROW.match(line)):
                try:
                    keys[source, "json", m[1], _kind_of(json.loads(m[2]))] += 1
                except ValueError:
                    pass
            elif first.isspace():
                continue
            elif first.isalpha() and PAIRS.match(line):
                kinds = [(k, _kind_of(_unquote(v))) for k, v in PAIR.findall(line)]
                if any(t in "TL" for _, t in kinds):
                    per[source, seq // BLOCK, -2] += 1
                for k, t in kinds:
                    keys[source, "pairs", k, t] += 1
            else:
                alike = VARIES.sub("0", line)
                at = known.get(alike)
                if at is None:
                    if len(known) >= CACHED:
                        known.clear()
                    at = known[alike] = miner.add(tokens_of(line))
                per[source, seq // BLOCK, at] += 1
    names = {-1: "{", -2: "="} | {k: SEP.join(t) for k, t in enumerate(miner.templates)}
    buckets = {-1: "{", -2: "="} | {k: bucket_of(t) for k, t in enumerate(miner.templates)}
    rows = [("tpl", s or "", block, buckets[k], names[k], n) for (s, block, k), n in per.items()]
    rows += [("key", s or "", 0, "", f"{form}{SEP}{k}{SEP}{t}", n) for (s, form, k, t), n in keys.items()]
    columns = list(zip(*rows)) or [[]] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["kind", "a", "block", "bucket", "b", "n"])


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Head of each template, after the templates of all partitions are merged."""
    miner = Miner()
    for _ in range(2):  # a template grows general while sequences come in: a second pass sees the final ones
        miner.cache.clear()
        at = [miner.add(tuple(b.split(SEP))) for b in rows["b"]]
    heads = [b if b in "{=" else head_of(tuple(b.split(SEP))) for b in rows["b"]]
    merged = [head_of(miner.templates[k]) for k in at]
    # merging must not lose a keyed slot: then the template's own head counts
    good = [m if m and sum(m.count(f"<{x}>") for x in KEYED) >= sum(h.count(f"<{x}>") for x in KEYED) else h for m, h in zip(merged, heads)]
    return pd.DataFrame({"b": rows["b"], "head": good})


def _file_roles(rows: pd.DataFrame) -> pd.DataFrame:
    """Role of each key of one file and form: T, L, I, M; N if all its values are level numbers; - if none."""
    form, out = rows["form"].iloc[0], []
    seen = {key: dict(zip(g["type"], g["n"])) for key, g in rows.groupby("key")}
    total = {key: sum(types.values()) for key, types in seen.items()}
    most = max(total.values())
    for key, types in seen.items():
        n, words, numbers = total[key], types.get("L", 0), types.get("N", 0)
        # what is left of a key whose row was cut within it is rare and ends another key
        if n < RARE * most or form == "pairs" and any(other != key and other.endswith(key) and n * 20 <= total[other] for other in total):
            continue
        best, role = max((types.get("T", 0), "T"), (words + numbers if words else 0, "L"), (types.get("I", 0), "I"), (types.get("M", 0), "M"))
        if best < MOSTLY * n:
            role = "N" if form == "json" and numbers == n and n >= MOSTLY * most else "-"
        out.append((form, key, role, n))
    return pd.DataFrame(out, columns=["form", "key", "role", "rows"])


def _key_role(r) -> tuple | None:
    """(form, key, role, whether its values are numbers only, rows) of a key, from its roles in the files that use it.

    It needs most of the files or nine tenths of the rows; for level words, files
    that have other things under the key (of objects within objects) do not count.
    """
    files, rows = ({x: r[f"{x}_{what}"] for x in ("-", *"TLNIM")} for what in ("files", "rows"))
    words = files["L"] > 0
    for count in (files, rows):
        count["L"] += count.pop("N")
    n, role = max((files[x], x) for x in "TLIM")
    enough = 2 * n >= sum(files.values()) or rows[role] >= MOSTLY * sum(rows.values()) or role == "L" and words
    return (r["form"], r["key"], role, role == "L" and not words, rows[role]) if n and enough else None


def mine_layouts(rows: DataFrame, *, share: float = SHARE, lead: float = LEAD, few: int = FEW) -> dict:
    """Layouts of all programs: header patterns, and the roles of keys.

    Only counts by (stretch of a file, template) are shuffled; what comes to the
    driver is one row for each layout and each key of JSON and key=value lines
    that carries a role, which depends on the programs and not on the number of
    rows.  Keys get their roles by file, so that a large file hides no key of a
    small one.  ``rejected``: rows whose head was taken for none.
    """
    from tidewell.workspace import Workspace

    ws = Workspace(rows.sparkSession)
    counts = rows.where(F.col("log").isNotNull()).select("source", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "log").mapInArrow(_mine, _MINED)
    counts = ws.write(counts.groupBy("kind", "a", "block", "bucket", "b").agg(F.sum("n").alias("n")), "templates")
    tpl = counts.where("kind = 'tpl'")
    heads = tpl.select("bucket", "b").distinct().groupBy("bucket").applyInPandas(_merge, "b string, head string")
    stretches = tpl.join(heads, "b").where("head <> ''").groupBy("a", "block", "head").agg(F.sum("n").alias("n"))
    stretches = stretches.withColumn("part", F.col("n") / F.sum("n").over(Window.partitionBy("a", "block")))
    leads = (F.col("part") >= lead) & (F.col("n") >= few)
    per_file = stretches.groupBy("a", "head").agg(F.sum("n").alias("n"), F.max(leads).alias("leads"))
    per_file = per_file.withColumn("part", F.col("n") / F.sum("n").over(Window.partitionBy("a")))
    per_head = per_file.groupBy("head").agg(F.sum("n").alias("n"), F.max(F.col("leads") | (F.col("part") >= share)).alias("header"))
    found = {r["head"]: r["n"] for r in per_head.groupBy(F.when(F.col("header"), F.col("head")).otherwise("").alias("head")).agg(F.sum("n").alias("n")).collect()}
    rejected = found.pop("", 0)
    common = counts.where("kind = 'key'").select("a", F.split("b", SEP).alias("k"), "n").select("a", F.col("k")[0].alias("form"), F.col("k")[1].alias("key"), F.col("k")[2].alias("type"), "n")
    by_file = common.groupBy("a", "form").applyInPandas(_file_roles, "form string, key string, role string, rows long")
    merged = by_file.groupBy("form", "key").pivot("role", ["-", *"TLNIM"]).agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))
    roles: dict[str, dict[str, list[str]]] = {}
    for form, key, role, _, _ in sorted(filter(None, map(_key_role, merged.na.fill(0).collect())), key=lambda x: (x[3], -x[4], x[1])):
        roles.setdefault(form, {}).setdefault(role, []).append(key)
    # the longest head first, so that one that is the beginning of another never hides it
    plain = sorted((h for h in found if h not in "{="), key=lambda h: (-len(h.split(SEP)), h))
    return {"patterns": [head_pattern(h) for h in plain], "heads": plain, "json": "{" in found, "pairs": "=" in found, "roles": roles, "rejected": rejected}


@lru_cache(maxsize=4096)
def _midnight(year: int, month: int, day: int) -> int:
    return calendar.timegm((year, month, day, 0, 0, 0))


def _clock(hms: str) -> int:
    return int(hms[:2]) * 3600 + int(hms[3:5]) * 60 + int(hms[6:8])


def _shift(zone: str) -> int:
    zone = zone.strip().replace(":", "")
    if not zone or zone[0] not in "+-":
        return 0
    seconds = int(zone[1:3]) * 3600 + int(zone[3:5]) * 60
    return seconds if zone[0] == "+" else -seconds


ZONE_END = re.compile(r"[+-]\d\d:?\d\d$")


def seconds_of(stamp) -> int | None:
    """Whole epoch seconds of a timestamp in any of the known forms, rounded down."""
    try:
        if isinstance(stamp, (int, float)) and not isinstance(stamp, bool):
            return int(stamp // 1000) if stamp > 1e11 else int(stamp // 1)
        s = stamp
        if s[4] == "-" and s[7] == "-" or s[4] == "/" and s[7] == "/":
            zone = ZONE_END.search(s, 19)
            return _midnight(int(s[:4]), int(s[5:7]), int(s[8:10])) + _clock(s[11:19]) - (_shift(zone[0]) if zone else 0)
        if s[2] == "/":
            return _midnight(int(s[7:11]), MONTHS[s[3:6]], int(s[:2])) + _clock(s[12:20]) - _shift(s[20:])
        if s[:3] in MONTHS:
            return _midnight(YEAR, MONTHS[s[:3]], int(s[4:6])) + _clock(s[7:15])
        if s[4] == " ":
            return _midnight(YEAR, int(s[:2]), int(s[2:4])) + _clock(s[5:13])
        whole, _, _ = s.partition(".")
        return int(whole) // 1000 if len(whole) == 13 else int(whole)
    except (ValueError, KeyError, IndexError, TypeError, OverflowError):
        return None


def level_of(value) -> str:
    if isinstance(value, str):
        got = LEVELS.get(value.strip().lower())
        if got:
            return got
        value = int(value) if value.strip().isdigit() else None
    return NUMBERS.get(value, "") if not isinstance(value, bool) and isinstance(value, (int, float)) else ""


class Parser:
    """Header of a line by the mined layouts."""

    def __init__(self, layouts: dict):
        self.patterns = [re.compile(p) for p in layouts["patterns"]]
        self.heads = layouts.get("heads") or [SLOT] * len(self.patterns)
        self.json, self.pairs = layouts["json"], layouts["pairs"]
        self.roles = {f: {r: list(k) for r, k in x.items()} for f, x in layouts["roles"].items()}
        self.fitting: dict[str, list] = {}  # patterns that a line with this first character may match, in their order

    def _fitting(self, first: str) -> list:
        kind = "d" if first.isdigit() else "u" if "A" <= first <= "Z" else "w" if first.isalpha() or first == "_" else "p"
        could = {"T": "du", "E": "d", "K": "u", "P": "p", "A": "d", "I": "uw", "L": "uw", "H": "uw", "X": "duw", "*": "dpuw"}
        if first not in self.fitting:
            out = []
            for p, head in zip(self.patterns, self.heads):
                x = head.split(SEP)[0]
                kinds = could[x[1]] if len(x) == 3 and x[0] == "<" else "dpuw" if x in (SLOT, SPACE) else None
                if kind in kinds if kinds else first.lower() == x[0].lower():
                    out.append(p)
            self.fitting[first] = out
        return self.fitting[first]

    def start(self, line: str):
        """What a line that begins an entry is parsed from, None if it begins none."""
        first = line[:1]
        if not first or first.isspace():
            return None
        if first == "{":
            return ("json",) if self.json and JSON_START.match(line) else None
        if "\x1b" in line:
            line = ANSI.sub("", line)
        for p in self._fitting(line[0]):  # by their order alone: the lines before must not matter
            m = p.match(line)
            if m:
                return ("head", m, line)
        if self.pairs and first.isalpha() and "=" in line:
            bare = line.rstrip("\r\n")
            if PAIRS.match(bare):
                pairs = {k: _unquote(v) for k, v in PAIR.findall(bare)}
                roles = self.roles.get("pairs", {})
                if any(k in pairs for k in roles.get("T", ())) or any(k in pairs for k in roles.get("L", ())):
                    return ("pairs", pairs)
        return None

    def _by_role(self, form: str, values: dict) -> tuple:
        got = {}
        for role, names in self.roles.get(form, {}).items():
            for name in names:
                if values.get(name) is not None:
                    got[role] = values[name]
                    break
        return seconds_of(got.get("T")), level_of(got.get("L")), str(got.get("I", "")), str(got.get("M", ""))

    def parse(self, begun, text: str) -> tuple:
        """(seconds or None, level, component, message) of a whole entry."""
        if begun[0] == "json":
            try:
                values, end = json.JSONDecoder(strict=False).raw_decode(text)
                sec, level, name, message = self._by_role("json", values if isinstance(values, dict) else {})
                return sec, level, name, (message + "\n" + text[end:].strip("\r\n")).strip("\n")
            except ValueError:
                return None, "", "", text
        if begun[0] == "pairs":
            sec, level, name, message = self._by_role("pairs", begun[1])
            _, _, more = text.partition("\n")
            return sec, level, name, (message + "\n" + more).strip("\r\n")
        m = begun[1]
        g = m.groupdict()
        sec = seconds_of(g.get("T") or g.get("E") or g.get("KT") or "")
        level = level_of(g["L"]) if g.get("L") else LETTERS.get(g["K"], "") if g.get("K") else SYSLOG[int(g["P"]) % 8] if g.get("P") else ""
        if "\x1b" in text:
            text = ANSI.sub("", text)
        return sec, level, g.get("I") or "", text[m.end() :].strip("\r\n")


class _Cutter:
    """Cuts rows of one stream, in order of seq, into entries."""

    def __init__(self, parser: Parser, with_message: bool = True):
        self.parser, self.with_message = parser, with_message
        self.reset(None)

    def reset(self, group) -> None:
        self.group, self.rows, self.begun, self.line_open = group, [], None, False

    def flush(self, out: list) -> None:
        """Emit what is open; rows is a list of (seq, log, time_ns)."""
        if not self.rows:
            return
        text = "".join(log for _, log, _ in self.rows)
        if self.begun == "line":
            self.begun = self.parser.start(text)
        sec, level, name, message = self.parser.parse(self.begun, text) if self.begun else (None, "", "", text.strip("\r\n"))
        if sec is None:
            sec = self.rows[0][2] // 1_000_000_000 if self.rows[0][2] is not None else None
        out.append((*self.group, self.rows[0][0], self.rows[-1][0], sec, level, name, message, bool(self.begun)))
        self.rows, self.begun = [], None

    def _end_line(self, out: list) -> bool:
        """The last line is whole: does it begin an entry?  If so, what came before is emitted."""
        k = self.line_at
        line = self.rows[k][1] if k == len(self.rows) - 1 else "".join(log for _, log, _ in self.rows[k:])
        begun = self.parser.start(line)
        if begun is None:
            return False
        mine = self.rows[k:]
        self.rows = self.rows[:k]
        self.flush(out)
        self.rows, self.begun = mine, begun
        return True

    def add(self, seq, log, time_ns, out: list) -> bool:
        """True if an entry was found to begin with this row's line."""
        if not self.line_open:
            self.line_at = len(self.rows)
        self.rows.append((seq, log, time_ns))
        self.line_open = not log.endswith("\n")
        if self.line_open:
            return False
        found = self._end_line(out)
        if not found and not self.with_message and len(self.rows) > HELD and not (self.begun and self.begun[0] == "json"):
            self.rows[HELD:] = [(seq, "\n", time_ns)]
        return found

    def finish(self, out: list) -> None:
        if self.line_open and self.rows:
            self._end_line(out)
        self.flush(out)


_ENTRY = [("source", pa.string()), ("stream", pa.string()), ("first_seq", pa.int64()), ("last_seq", pa.int64()), ("entry_sec", pa.int64()), ("level", pa.string()), ("component", pa.string()), ("message", pa.string()), ("headed", pa.bool_())]
_RAW = [("raw_seq", pa.int64()), ("raw_log", pa.string()), ("raw_ns", pa.int64())]
ENTRY_SCHEMA = "source string, stream string, first_seq long, last_seq long, entry_sec long, level string, component string, message string, headed boolean"
_CUT_SCHEMA = ENTRY_SCHEMA + ", raw_seq long, raw_log string, raw_ns long"


def _batch(entries: list, raw: list, with_message: bool) -> pa.RecordBatch:
    cols = list(zip(*entries)) if entries else [[]] * 9
    n, r = len(entries), len(raw)
    arrays = []
    for i, (_, t) in enumerate(_ENTRY):
        values = list(cols[i])
        if i == 7 and not with_message:
            values = [None] * n
        arrays.append(pa.array(values + ([x[i] for x in raw] if i < 2 else [None] * r), t))
    arrays += [pa.array([None] * n + [x[i] for x in raw], t) for i, (_, t) in enumerate(_RAW, 2)]
    return pa.RecordBatch.from_arrays(arrays, names=[k for k, _ in _ENTRY + _RAW])


def _cut_partition(layouts: dict, with_message: bool):
    """Cuts one range partition; rows at its borders come out raw.

    The first stream may have begun in the partition before: its rows up to the
    first entry that surely begins here are left raw, and so is the last entry of
    the last stream, which may go on in the next partition.
    """

    def cut(batches):
        parser = Parser(layouts)
        cutter, last = _Cutter(parser, with_message), None
        head: list | None = []  # of the first stream; None once an entry surely began
        for batch in batches:
            out: list = []
            raw: list = []
            for source, stream, seq, log, ns in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if last == (source, stream, seq):
                    continue  # a repeated row
                last = (source, stream, seq)
                if cutter.group != (source, stream):
                    if cutter.group is not None:
                        if head is not None:
                            raw += [(*cutter.group, *x) for x in head]
                            head = None
                        else:
                            cutter.finish(out)
                    cutter.reset((source, stream))
                if head is None:
                    cutter.add(seq, log, ns, out)
                    continue
                if not cutter.line_open:
                    line_at = len(head)
                head.append((seq, log, ns))
                cutter.line_open = not log.endswith("\n")
                if not cutter.line_open and line_at and (begun := parser.start("".join(x[1] for x in head[line_at:]))):
                    raw += [(*cutter.group, *x) for x in head[:line_at]]
                    cutter.rows, cutter.begun, head = head[line_at:], begun, None
                elif not cutter.line_open and not with_message and len(head) > HELD:
                    head[HELD:] = [(seq, "\n", ns)]
            yield _batch(out, raw, with_message)
        if cutter.group is not None:
            yield _batch([], [(*cutter.group, *x) for x in (cutter.rows if head is None else head)], with_message)

    return cut


def _cut_borders(layouts: dict, with_message: bool):
    """Cuts the raw rows of one stream that lie at the borders of partitions."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("raw_seq")
        cutter, out = _Cutter(Parser(layouts), with_message), []
        cutter.reset((rows["source"].iloc[0], rows["stream"].iloc[0]))
        for seq, log, ns in zip(rows["raw_seq"].tolist(), rows["raw_log"].tolist(), rows["raw_ns"].tolist()):
            cutter.add(seq, log, None if ns is None or ns != ns else int(ns), out)
        cutter.finish(out)
        frame = pd.DataFrame(out, columns=[k for k, _ in _ENTRY])
        if not with_message:
            frame["message"] = None
        return frame.astype({"entry_sec": "Int64"})

    return cut


NO_STREAM = "\x00"  # stands for a null stream, which is one stream of its file


def log_entries(rows: DataFrame, *, layouts: dict | None = None, with_message: bool = True) -> DataFrame:
    """``source, stream, first_seq, last_seq, entry_sec, level, component, message, headed`` of every entry.

    rows: ``source, seq, log, stream, time_ns``; other columns are ignored.
    layouts: what :func:`mine_layouts` returned; mined from these rows if None.

    Defined results: each (source, seq) counts once (within its stream); rows
    with a null source, seq or log are ignored; a null stream is one stream of
    its file; rows before the first header of a stream form one entry with
    ``headed`` false, timed by its first row; a row without newline at the end
    of its stream is a whole line; null time_ns and no timestamp give a null
    entry_sec; an empty table gives none.
    """
    from tidewell.workspace import Workspace

    layouts = mine_layouts(rows) if layouts is None else layouts
    plain = rows.select("source", F.coalesce("stream", F.lit(NO_STREAM)).alias("stream"), "seq", "log", "time_ns").where(F.col("source").isNotNull() & F.col("seq").isNotNull() & F.col("log").isNotNull())
    ordered = plain.repartitionByRange("source", "stream", "seq").sortWithinPartitions("source", "stream", "seq")
    cut = ordered.mapInArrow(_cut_partition(layouts, with_message), _CUT_SCHEMA)
    cut = Workspace(rows.sparkSession).write(cut, "cut")
    names = [k for k, _ in _ENTRY]
    whole = cut.where(F.col("raw_log").isNull()).select(*names)
    borders = cut.where(F.col("raw_log").isNotNull()).groupBy("source", "stream").applyInPandas(_cut_borders(layouts, with_message), ENTRY_SCHEMA)
    return whole.unionByName(borders).withColumn("stream", F.nullif("stream", F.lit(NO_STREAM)))
