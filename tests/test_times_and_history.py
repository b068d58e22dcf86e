"""Stated times and attribute histories against stated cases and a plain fold."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from bidweave.operators import history, instants

NY, LONDON = "America/New_York", "Europe/London"
CASES = [
    ("March 5, 2025 at 2:00 PM", NY, "MDY", "2025-03-05T19:00:00"),
    ("the 26th day of October, 2026 - 14:45 PT", NY, "MDY", "2026-10-26T21:45:00"),
    ("13:00:00, July 12, 2026", NY, "MDY", "2026-07-12T17:00:00"),
    ("12 July 2026, 9:00am", NY, "MDY", "2026-07-12T13:00:00"),
    ("10-MAR-2025 at 14:30 atlantic time", NY, "MDY", "2025-03-10T17:30:00"),
    ("04/05/24 1 p.m.", NY, "MDY", "2024-04-05T17:00:00"),
    ("04/05/24 1 p.m.", LONDON, "DMY", "2024-05-04T12:00:00"),
    ("1415 hrs, 5-6-2024", NY, None, "2024-05-06T18:15:00"),
    ("2025-03-07 23:30:00 UTC-4", LONDON, "DMY", "2025-03-08T03:30:00"),
    ("20250601T14:15-04:00[America/New_York]", LONDON, "DMY", "2025-06-01T18:15:00"),
    ("2025-08-08T17:30:59.7557029-0800", LONDON, "DMY", "2025-08-09T01:30:59.755702"),
    ("2024/06/24 16:00:00Z", NY, "MDY", "2024-06-24T16:00:00"),
    ("1734478200", NY, "MDY", "2024-12-17T23:30:00"),
    ("1741813200007", NY, "MDY", "2025-03-12T21:00:00.007000"),
    ("July 1, 2025 9:00 AM EST", NY, "MDY", "2025-07-01T14:00:00"),
    ("Nov 2, 2025 at 1:30 AM", NY, "MDY", "2025-11-02T05:30:00"),
    ("March 9, 2025 at 2:15 AM", NY, "MDY", "2025-03-09T07:15:00"),
    ("12/09/23 @ 12:00 noon", NY, "MDY", "2023-12-09T17:00:00"),
    ("Jan 1 2026 12:00 a.m.", NY, "MDY", "2026-01-01T05:00:00"),
    ("  \xa0June 3, 2025 10:00 AM\n", NY, "MDY", "2025-06-03T14:00:00"),
    ("December 31, 2085 5:00 PM", NY, "MDY", "2085-12-31T22:00:00"),
    ("July 4, 2085 5:00 PM", NY, "MDY", "2085-07-04T21:00:00"),
    ("March 5, 1965 10:00 AM", NY, "MDY", "1965-03-05T15:00:00"),
    ("March 5, 0001 10:00 AM", "UTC", "MDY", "0001-03-05T10:00:00"),
    ("Dec 31, 9999 10:00 PM", "UTC", "MDY", "9999-12-31T22:00:00"),
    ("June 3, 2025 10:00 AM", "EST5EDT", "MDY", "2025-06-03T14:00:00"),
    ("June 3, 2025 10:00 AM", "Japan", "MDY", "2025-06-03T01:00:00"),
    ("June 3, 2025 10:00 AM PST8PDT", NY, "MDY", "2025-06-03T17:00:00"),
    ("June 3, 2025 10:00 AM", "Nowhere/Land", "MDY", None),
    ("June 3, 2025 10:00 AM", None, "MDY", None),
    ("February 30, 2024 at 2:00 PM", NY, "MDY", None),
    ("2025-13-19 10:00", NY, "MDY", None),
    ("25/12/2024 10:00", NY, "MDY", None),
    ("2:00 PM CST", NY, "MDY", None),
    ("October 19, 2024", NY, "MDY", None),
    ("January 2024", NY, "MDY", None),
    ("Daily between 9:00 AM and 2:00 PM", NY, "MDY", None),
    ("13:00 PM on May 1, 2025", NY, "MDY", None),
    ("", NY, "MDY", None),
    (None, NY, "MDY", None),
    ("x" * 20000, NY, "MDY", None),
]


@pytest.fixture(scope="module")
def labels(spark):
    rows = [("EST", "-05:00"), ("Z", "+00:00"), ("UTC", "+00:00"), ("PT", "America/Los_Angeles"), ("Atlantic Time", "America/Halifax"), (None, None)]
    return spark.createDataFrame(rows, "label string, zone_id string")


def test_instants(spark, labels):
    df = spark.createDataFrame([(i, v, z, o, "kept") for i, (v, z, o, _) in enumerate(CASES)], "k int, value string, tz_name string, date_order string, spans string")
    got = {r.k: r for r in instants.to_instants(df, labels).collect()}
    assert len(got) == len(CASES) and got[0].spans == "kept"
    for i, (value, _, _, want) in enumerate(CASES):
        at = None if got[i].utc_us is None else (datetime(1970, 1, 1) + timedelta(microseconds=got[i].utc_us)).isoformat()
        assert at == want, value
    kinds = {CASES[i][0]: r.wall_kind for i, r in got.items()}
    assert kinds["Nov 2, 2025 at 1:30 AM"] == "ambiguous" and kinds["March 9, 2025 at 2:15 AM"] == "skipped"
    assert instants.to_instants(df.limit(0), labels).collect() == []


@pytest.mark.parametrize("limit", [0, 100_000])
def test_every_zone_and_many_years(spark, labels, monkeypatch, limit):
    """Noon of the first of March in every zone and in years of every century, against the zones' rules."""
    from zoneinfo import ZoneInfo, available_timezones

    monkeypatch.setattr(instants, "BROADCAST_YEARS", limit)
    zones = sorted(available_timezones())
    cells = [(z, y) for i, z in enumerate(zones) for y in (1850 + i % 100, 1990 + i % 60, 2100 + i)]
    df = spark.createDataFrame([(i, f"1 March {y} 12:00", z, "MDY") for i, (z, y) in enumerate(cells)], "k int, value string, tz_name string, date_order string")
    for r in instants.to_instants(df, labels).collect():
        z, y = cells[r.k]
        want = datetime(y, 3, 1, 12, tzinfo=ZoneInfo(z)) - datetime(1970, 1, 1, tzinfo=UTC)
        assert r.utc_us == round(want.total_seconds()) * 10**6, (z, y)


def test_intervals_match_zone_rules(spark):
    """Every hour of some years: the intervals give the offset that the zone's rules give."""
    from zoneinfo import ZoneInfo

    zones = ("america/new_york", "africa/casablanca", "asia/kolkata")
    keys = spark.createDataFrame([(z, y) for z in (*zones, "no/zone") for y in (1985, 2025)], "zone_key string, wall_year int")
    rows = {(r.zone_key, r.wall_year): r.spans for r in instants.zone_intervals(keys).collect()}
    assert len(rows) == 6
    for (key, year), spans in rows.items():
        zone = ZoneInfo({"america/new_york": NY, "africa/casablanca": "Africa/Casablanca", "asia/kolkata": "Asia/Kolkata"}[key])
        at = int(datetime(year, 1, 2, tzinfo=UTC).timestamp())
        while datetime.fromtimestamp(at, UTC).year == year and datetime.fromtimestamp(at, UTC).timetuple().tm_yday < 364:
            offset = int(datetime.fromtimestamp(at, UTC).astimezone(zone).utcoffset().total_seconds())
            wall = (at + offset) * 10**6
            assert offset in [s.offset_s for s in spans if s.from_us <= wall < s.to_us]
            at += 3600


SCHEMA = "change_id long, bid_id string, addendum_number int, ord int, field string, old_value string, new_value string, file_name string, word int"


def fold(rows, files):
    numbers = dict(files)
    kept = {}
    for r in rows:
        n = r[2] if r[2] is not None else numbers.get(r[7])
        if n is None or not (r[4] or "").strip() or not (r[6] or "").strip():
            continue
        kept.setdefault((r[1], r[4].strip().lower()), []).append((n, r[3], r[0], r[5], r[6]))
    out = set()
    for (bid, field), own in kept.items():
        own.sort()
        norm = lambda v: None if v is None else v.strip().lower()
        found, held = [0], norm(own[0][3])
        for n in sorted({x[0] for x in own}):
            v = max(x for x in own if x[0] == n)[4]
            if norm(v) != held:
                found.append(n)
                held = norm(v)
        out |= {(bid, field, a, b) for a, b in zip(found, [*found[1:], -1])}
    return out


def test_versions_match_fold(spark):
    rng = random.Random(1)
    files = [("f1", 3), ("f2", None)]
    rows = []
    for i in range(1500):
        rows.append((i, rng.choice(["a", "b"]), rng.choice([None, *range(1, 200)]), rng.randrange(1, 4), rng.choice(["Due", " due ", "Title", None, " "]), rng.choice([None, "x"]), rng.choice(["x", "X ", "y", "z", None, ""]), rng.choice(["f1", "f2", None]), 1))
    rows += rows[:100]
    df = spark.createDataFrame(rows, SCHEMA)
    f = spark.createDataFrame([("a", n, k) for n, k in files] + [("b", n, k) for n, k in files], "bid_id string, file_name string, addendum_number int")
    got = [(r.bid_id, r.field, r.valid_from, r.valid_to) for r in history.versions(df, f).collect()]
    assert len(got) == len(set(got)) and set(got) == fold(rows, files)
    assert any(w > history.WORD for w in (x[2] for x in got))  # bitmaps of several words
    assert history.versions(df.limit(0), f).collect() == []
