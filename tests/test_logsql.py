"""LogQL to LogsQL."""

import pytest

from tidewell.plans.logql_syntax import Matcher
from tidewell.plans.logsql import TranslationError, inject_scope, to_logsql

GOOD = {
    '{a="x", b!="y"} |= "s" != "t" |~ "r.e" != ""': '_stream:{"a"="x","b"!="y"} *"s"* !*"t"* ~"(?-s:r.e)" !~".*"',
    '{a="x"} |= ""': '_stream:{"a"="x"}',
    '{a="x"} | l="v" or m!~"w"': '_stream:{"a"="x"} ("l":="v" or !"m":~"^(?s:w)$")',
    '{a="x"} | logfmt | l="v" and (m="1" or n="2")': '_stream:{"a"="x"} | unpack_logfmt keep_original_fields | filter "l":="v" ("m":="1" or "n":="2")',
    '{a="x"} | regexp "(?P<n>.)" |= "z"': '_stream:{"a"="x"} | extract_regexp "(?-s:(?P<n>.))" keep_original_fields | filter *"z"*',
    'count_over_time({a="x"}[5m])': '_time:(now-5m,now] _stream:{"a"="x"} | stats by (_stream) count() as value',
    'sum by (l) (rate({a="x"} | logfmt [1m])) * 2 > 3': '_time:(now-1m,now] _stream:{"a"="x"} | unpack_logfmt keep_original_fields | stats by ("l") count() as value | math (value / 60) as value | math (value * 2) as value | filter value:>3',
    'max by (l) (bytes_over_time({a="x"}[1h]))': '_time:(now-1h,now] _stream:{"a"="x"} | stats by (_stream, "l") sum_len(_msg) as value | stats by ("l") max(value) as value',
    '1 + 2 - sum(count_over_time({a="x"}[1h])) == 4': '_time:(now-1h,now] _stream:{"a"="x"} | stats count() as "tidewell.rows", count() as value | filter "tidewell.rows":>0 | delete "tidewell.rows" | math (3 - value) as value | filter value:>=4 value:<=4',
    '10 > sum by (a) (count_over_time({a="x"}[1h]))': '_time:(now-1h,now] _stream:{"a"="x"} | stats by ("a") count() as value | filter value:<10',
}


@pytest.mark.parametrize(("text", "want"), GOOD.items())
def test_translation(text, want):
    assert to_logsql(text) == want


def test_json_and_pattern():
    assert 'unpack_json from "tidewell.json" keep_original_fields' in to_logsql('{a="x"} | json')
    got = to_logsql('{a="x"} | pattern "lead <ip> - <_> <rest>"')
    assert 'extract if (_msg:="lead "*) "lead <plain:ip> - <plain:tidewell.skip1> <plain:rest>"' in got and "delete tidewell.skip1" in got


@pytest.mark.parametrize(
    ("text", "named"),
    [('{a="x"} | json b="c"', "json extraction"), ('{a="x"} | json | logfmt', "second parser"), ('{a="x"} | json | b_c="d"', "b_c"), ('{a="x"} | n>1', "number"), ('{a="x"} | json | __error__=""', "__error__"), ('{a="x"} | _x="1"', "_x"), ('count_over_time({a="x"} | logfmt [1m])', "no enclosing sum"), ('topk(1, rate({a="x"}[1m]))', "topk"), ('sum without (a) (rate({a="x"}[1m]))', "without"), ('rate({a="x"}[1m]) > bool 1', "bool"), ('rate({a="x"}[1m]) % 2', "operator %"), ('1 / rate({a="x"}[1m])', "operator /")],
)
def test_rejections(text, named):
    with pytest.raises(TranslationError, match=named.replace("(", r"\(")):
        to_logsql(text)


def test_scope():
    m = [Matcher("namespace", "=", "shop")]
    assert inject_scope('error or "a | b" | stats count()', m) == '_stream:{"namespace"="shop"} (error or "a | b") | stats count()'
    assert inject_scope("_time:(now-5m,now] x", m) == '_stream:{"namespace"="shop"} (_time:(now-5m,now] x)'
    for bad in ('"open', "x) or (y", "(a] b) or (c"):
        with pytest.raises(TranslationError):
            inject_scope(bad, m)
