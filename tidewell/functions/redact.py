"""Redaction of texts and of values under secret names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: the placeholder, names of secrets, and the patterns in their order --------------
MASK = "<redacted>"
NAMES = (
    "password", "passwd", "pwd", "secret", "token", "access_token", "refresh_token", "id_token",
    "api_key", "apikey", "api-key", "authorization", "auth", "credential", "credentials",
    "private_key", "client_secret", "session", "sessionid", "cookie", "set-cookie", "x-api-key",
    "aws_secret_access_key", "aws_session_token", "dsn", "connection_string", "passphrase",
)
PATTERNS = (
    (r"(?i)\b((?:proxy-)?authorization)(\s*[:=]\s*)[^\r\n,;]+", r"$1$2<redacted>"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(-----END [A-Z ]*PRIVATE KEY-----|\z)", r"<redacted>"),
    (r"(?i)\b(bearer|basic|token)\s+[A-Za-z0-9._~+/=-]{8,}", r"$1 <redacted>"),
    (r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\b", r"<redacted>"),
    (r"\b(AKIA|ASIA)[A-Z0-9]{16}\b", r"<redacted>"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", r"<redacted>"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}\b", r"<redacted>"),
    (r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b", r"<redacted>"),
    (r"\bsk-[A-Za-z0-9_-]{20,}\b", r"<redacted>"),
    (r"\bAIza[0-9A-Za-z_-]{35}\b", r"<redacted>"),
    (r"\bemx1_[a-z]_[A-Za-z0-9._-]+_[A-Za-z0-9._-]{8,}\b", r"<redacted>"),
    (r"([a-zA-Z][a-zA-Z0-9+.-]*://)([^:/@\s]+):([^@/\s]+)@", r"$1$2:<redacted>@"),
)
# -----------------------------------------------------------------------------------------------------


def patterns_of(names: tuple[str, ...] = NAMES, extra: tuple[str, ...] = ()) -> tuple[tuple[str, str], ...]:
    """All patterns: the fixed ones, then values that follow the names of secrets in their quotes, then ``extra`` ones."""
    named = "(?:" + "|".join(re.escape(n).replace(r"\-", "-") for n in names) + ")"
    values = (
        (rf'(?i)("{named}"\s*:\s*")([^"]*)(")', f"$1{MASK}$3"), (rf'(?i)\b({named}\s*[=:]\s*")([^"]*)(")', f"$1{MASK}$3"),
        (rf"(?i)\b({named}\s*[=:]\s*')([^']*)(')", f"$1{MASK}$3"), (rf"(?i)\b({named}\s*[=:]\s*)([^\s,;&\"'}}\]]+)", f"$1{MASK}"),
    )
    return (*PATTERNS, *values, *((p, MASK) for p in extra))


def redact_text(text: Column, patterns: tuple[tuple[str, str], ...] | None = None) -> Column:
    """The text with every pattern replaced, in order."""
    for pattern, replacement in patterns or patterns_of():
        text = F.regexp_replace(text, pattern, replacement)
    return text


def is_secret_key(name: Column, names: tuple[str, ...] = NAMES) -> Column:
    """Does a label of this name always hold a secret?  It is a name of the list, or holds one of more than four letters."""
    low = F.lower(name)
    return low.isin(*names) | low.rlike("|".join(re.escape(n) for n in names if len(n) > 4))


def redact_labels(labels: Column) -> Column:
    """Labels whose names are secret lose their values; the others are redacted as texts."""
    return F.transform_values(labels, lambda k, v: F.when(is_secret_key(k), F.lit(MASK)).otherwise(redact_text(v)))


def is_secret_field(name: str, names: tuple[str, ...] = NAMES) -> bool:
    """Does a field of an object hold a secret?  Its name ends in one of the list, whatever its case, _ and -."""
    return _folded(name).endswith(tuple(_folded(n) for n in names))


def _folded(name: str) -> str:
    return name.lower().replace("_", "").replace("-", "")


def _tree(value, patterns):
    if isinstance(value, dict):
        env = value.get("env")
        if isinstance(env, list):
            value = value | {"env": [x | {"value": MASK} if isinstance(x, dict) and "value" in x else x for x in env]}
        return {k: MASK if isinstance(v, str) and is_secret_field(k) else _tree(v, patterns) for k, v in value.items()}
    if isinstance(value, list):
        return [_tree(v, patterns) for v in value]
    if isinstance(value, str):
        for p, r in patterns:
            value = p.sub(r, value)
    return value


APPLIED = "kubectl.kubernetes.io/last-applied-configuration"  # fixed value: an annotation that repeats the whole object
VALUES = {"Secret": ("data", "stringData"), "ConfigMap": ("data", "binaryData")}


def _object(kind: str | None, value, patterns):
    """An object with the values of its kind replaced, and its tree redacted."""
    if not isinstance(value, dict):
        return _tree(value, patterns)
    meta = value.get("metadata")
    if isinstance(meta, dict):
        meta = {k: v for k, v in meta.items() if k != "managedFields"}
        if isinstance(meta.get("annotations"), dict):
            meta["annotations"] = {k: MASK if kind == "Secret" or k == APPLIED else v for k, v in meta["annotations"].items()}
        value = value | {"metadata": meta}
    for part in VALUES.get(kind, ()):
        if isinstance(value.get(part), dict):
            value = value | {part: dict.fromkeys(value[part], MASK)}
    return _tree(value, patterns)


def _redact_objects(kinds, texts):
    import json

    patterns = [(re.compile(p.replace(r"\z", r"\Z")), re.sub(r"\$(\d)", r"\\\1", r)) for p, r in patterns_of()]

    def one(kind, text):
        if text is None:
            return None
        try:
            return json.dumps(_object(kind, json.loads(text), patterns), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return _tree(text, patterns)

    return pd.Series([one(k, t) for k, t in zip(kinds, texts)], dtype=object)


@F.pandas_udf(T.StringType())
def redact_object(kinds: pd.Series, texts: pd.Series) -> pd.Series:
    """JSON texts of objects of the given kinds: values of secrets and config maps, of environments and under secret names are replaced.

    What is no JSON is redacted as text; null stays null.
    """
    return _redact_objects(kinds, texts)


@F.pandas_udf(T.StringType())
def redact_json(texts: pd.Series) -> pd.Series:
    """The same without a kind."""
    return _redact_objects([None] * len(texts), texts)


def expand_template(template: str, labels: Column, value: Column) -> Column:
    """``{{ $labels.x }}`` and ``{{ $value }}`` of an annotation, filled in."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*\$(?:labels\.([A-Za-z_]\w*)|value)\s*\}\}", template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(F.coalesce(F.element_at(labels, F.lit(m[1])), F.lit("")) if m[1] else value.cast("string"))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def truncate_utf8(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, most)
    # a character cut in its bytes is dropped; at most three bytes can be left of one
    tries = [F.try_validate_utf8(F.substring(F.encode(text, "UTF-8"), 1, most - k).cast("string")) for k in range(1, 4)]
    whole = F.try_validate_utf8(cut.cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(whole, *tries))
