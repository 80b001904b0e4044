"""Five-field schedules: lists, ranges, steps, names and shortcuts; a day matches by date or weekday if both are given."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each field's first and last number, the names and the shortcuts.
FIELDS = [("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7)]
MONTHS = {m: k + 1 for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
WEEKDAYS = {w: k for k, w in enumerate("sun mon tue wed thu fri sat".split())}
SHORTCUTS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}


def _number(word: str, names: dict[str, int]) -> int:
    return names[word.lower()] if word.lower() in names else int(word)


def _field(spec: str, kind: str, low: int, high: int) -> frozenset[int]:
    names = MONTHS if kind == "month" else WEEKDAYS if kind == "weekday" else {}
    out: set[int] = set()
    for part in spec.split(","):
        body, _, step = part.partition("/")
        every = int(step) if step else 1
        if every <= 0:
            raise ValueError(f"step in {part!r}")
        if body == "*":
            first, last = low, high
        elif "-" in body:
            first, last = (_number(x, names) for x in body.split("-", 1))
        else:
            first = _number(body, names)
            last = high if step else first
        if not low <= first <= last <= high:
            raise ValueError(f"{kind} {part!r} is outside {low}-{high}")
        out.update(range(first, last + 1, every))
    return frozenset(x % 7 for x in out) if kind == "weekday" else frozenset(out)


@dataclass(frozen=True)
class Cron:
    minute: frozenset[int]
    hour: frozenset[int]
    day: frozenset[int]
    month: frozenset[int]
    weekday: frozenset[int]
    any_day: bool
    any_weekday: bool

    def matches(self, t: datetime) -> bool:
        by_date, by_weekday = t.day in self.day, t.isoweekday() % 7 in self.weekday
        on_day = (by_date and by_weekday) if self.any_day or self.any_weekday else (by_date or by_weekday)
        return t.minute in self.minute and t.hour in self.hour and t.month in self.month and on_day

    def walk(self, t: datetime, minutes: int, most: int = 366 * 24 * 60 * 5) -> datetime | None:
        """The first matching minute from t on, in steps of +1 or -1; days that do not match are skipped whole."""
        t = t.replace(second=0, microsecond=0)
        end = t + timedelta(minutes=most) * minutes
        while (t <= end) if minutes > 0 else (t >= end):
            if self.matches(t):
                return t
            day_fits = any(self.matches(t.replace(hour=h, minute=m)) for h in self.hour for m in list(self.minute)[:1])
            if day_fits:
                t += timedelta(minutes=minutes)
            else:
                t = (t.replace(hour=0, minute=0) + timedelta(days=1)) if minutes > 0 else (t.replace(hour=0, minute=0) - timedelta(minutes=1))
        return None

    def next(self, t: datetime) -> datetime | None:
        return self.walk(t + timedelta(minutes=1), 1)

    def prev(self, t: datetime) -> datetime | None:
        return self.walk(t, -1)


def parse(spec: str) -> Cron:
    parts = SHORTCUTS.get(spec.strip(), spec).split()
    if len(parts) != 5:
        raise ValueError(f"a schedule has five fields: {spec!r}")
    sets = [_field(p, *f) for p, f in zip(parts, FIELDS)]
    return Cron(*sets, any_day=parts[2].startswith("*"), any_weekday=parts[4].startswith("*"))


def cron_column(spec: str, ts: Column) -> Column:
    """Whether a timestamp's minute matches."""
    c = parse(spec)
    by_date, by_weekday = F.dayofmonth(ts).isin(*c.day), (F.dayofweek(ts) - 1).isin(*c.weekday)
    on_day = (by_date & by_weekday) if c.any_day or c.any_weekday else (by_date | by_weekday)
    return F.minute(ts).isin(*c.minute) & F.hour(ts).isin(*c.hour) & F.month(ts).isin(*c.month) & on_day


def occurrences(spec: str, duration_us: int, first: datetime, last: datetime) -> list[tuple[int, int]]:
    """(start, end) in microseconds of each window that begins between first and last, for a join by interval."""
    c, out, t = parse(spec), [], parse(spec).walk(first, 1)
    while t is not None and t <= last:
        start = int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        out.append((start, start + duration_us))
        t = c.next(t)
    return out
