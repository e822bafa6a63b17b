"""The last time at or before an instant at which a cron schedule fires."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

# --- fixed values: names and descriptors of the format -------------------------
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
DAYS = {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split())}
NAMED = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
# --------------------------------------------------------------------------------


class CronError(ValueError):
    """A schedule that can't be read, or never fires."""


def _field(text: str, low: int, high: int, names: dict[str, int]) -> tuple[set[int], bool]:
    """(values, starred)."""
    out: set[int] = set()
    starred = False
    for part in text.split(","):
        body, _, step = part.partition("/")
        if step and (not step.isdigit() or not int(step)):
            raise CronError(f"bad step {part!r}")
        if body in ("*", "?"):
            a, b, starred = low, high, starred or not step
        else:
            ends = [names.get(x.lower(), int(x) if x.isdigit() else -1) for x in body.split("-")]
            if len(ends) > 2:
                raise CronError(f"bad range {part!r}")
            a, b = ends[0], ends[-1] if len(ends) == 2 or not step else high
        # where a name stands for 0 (Sunday), one above the highest value does so too
        most = high + 1 if names and not low else high
        if not low <= a <= b <= most:
            raise CronError(f"{part!r} is out of range")
        out.update(v % (high + 1) for v in range(a, b + 1, int(step) if step else 1))
    return out, starred


def previous(spec: str, zone: str, at_ms: int) -> int:
    """Milliseconds of the last time at or before ``at_ms``; five fields, descriptors, @every, CRON_TZ.

    ``zone`` beats the zone that the text names.
    """
    m = re.match(r"(?:CRON_TZ|TZ)=(\S+)\s+(.*)", spec.strip())
    if m:
        zone, spec = zone or m[1], m[2]
    try:
        tz = ZoneInfo(zone) if zone else UTC
    except Exception as e:
        raise CronError(f"unknown time zone {zone!r}") from e
    spec = spec.strip()
    if spec.startswith("@every "):
        from tidewell.plans.logql_syntax import parse_duration

        ns = parse_duration(spec[7:].strip())
        if not ns or ns < 10**9:
            raise CronError(f"bad interval {spec!r}")
        step = ns // 10**9 * 1000
        return at_ms // step * step
    fields = NAMED.get(spec.lower(), spec).split()
    if len(fields) != 5:
        raise CronError(f"a schedule needs five fields: {spec!r}")
    minutes, _ = _field(fields[0], 0, 59, {})
    hours, _ = _field(fields[1], 0, 23, {})
    days, any_day = _field(fields[2], 1, 31, {})
    months, _ = _field(fields[3], 1, 12, MONTHS)
    weekdays, any_weekday = _field(fields[4], 0, 6, DAYS)
    here = datetime.fromtimestamp(at_ms // 1000, tz)
    day = here.date()
    for _ in range(366 * 5):
        by_day, by_weekday = day.day in days, (day.weekday() + 1) % 7 in weekdays
        fits = by_day and by_weekday if any_day or any_weekday else by_day or by_weekday
        if day.month in months and fits:
            for h in sorted(hours, reverse=True):
                for minute in sorted(minutes, reverse=True):
                    t = datetime(day.year, day.month, day.day, h, minute, tzinfo=tz)
                    ms = int(t.timestamp() * 1000)
                    if ms <= at_ms and datetime.fromtimestamp(ms / 1000, tz).hour == h:
                        return ms
        day -= timedelta(days=1)
    raise CronError(f"{spec!r} does not fire in five years")
