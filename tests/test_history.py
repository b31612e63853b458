"""Validity intervals of reference tables against a plain scan of the snapshots."""

import random

import pytest

from pathlight.sources.catalog import Catalog
from pathlight.sources.history import History

KEYS = ["prefix", "asn"]
DATES = ["2025-01-01", "2025-01-03", "2025-01-04", "2025-02-01"]


def table(spark, rows):
    return spark.createDataFrame(rows, "prefix string, asn bigint, note string")


def test_intervals_equal_a_scan(spark, tmp_path):
    rng, held = random.Random(5), History(spark, str(tmp_path))
    keys = [(f"10.{i}.0.0/16", rng.choice([None, 5, 6])) for i in range(25)]
    seen = {d: sorted({k for k in keys if rng.random() < 0.6}, key=str) for d in DATES}
    seen[DATES[0]] = sorted(set(seen[DATES[0]]) | {keys[0]}, key=str)
    for d in DATES:
        for _ in range(2):  # the last date again changes nothing
            held.add("roa", table(spark, [(*k, d) for k in seen[d] * 2]), KEYS, d)
    want, status = [], {}
    for k in keys:
        here = [k in seen[d] for d in DATES]
        runs, start = [], None
        for i, x in enumerate([*here, False]):
            if x and start is None:
                start = i
            if not x and start is not None:
                runs.append((start, i - 1))
                start = None
        want += [(*k, DATES[a], DATES[b], b - a + 1) for a, b in runs]
        if runs:
            last = len(DATES) - 1
            kind = "unstable" if len(runs) > 1 or (runs[0][0] > 0 and runs[0][1] < last) else "stable" if runs[0] == (0, last) else "new" if runs[0][1] == last else "left"
            status[k] = (DATES[runs[0][0]], DATES[runs[-1][1]], sum(here), kind, here[-1])
    assert sorted(map(str, (tuple(r) for r in held.intervals("roa").collect()))) == sorted(map(str, want))
    got = {tuple(r)[:2]: tuple(r)[2:] for r in held.presence("roa", KEYS).collect()}
    assert got == status and {s[3] for s in status.values()} == {"stable", "new", "left", "unstable"}
    assert held.dates("roa") == DATES and spark.read.parquet(f"{tmp_path}/roa/snapshots").select("snapshot_date").distinct().count() == 4
    with pytest.raises(ValueError, match="before the last"):
        held.add("roa", table(spark, []), KEYS, "2025-01-02")


def test_one_failing_source_leaves_the_others_alone(spark, tmp_path):
    held = History(spark, str(tmp_path))
    good = lambda: table(spark, [("10.0.0.0/8", 1, "x")])
    sources = {"roa": (good, KEYS), "bad": (lambda: good().select("nothing"), KEYS), "empty": (lambda: table(spark, []), KEYS)}
    report = held.sync(sources, DATES[0], "r1")
    assert report["roa"] == 1 and report["empty"] == 0 and "nothing" in report["bad"] and held.dates("bad") == []
    assert held.sync(sources, DATES[1], "r2")["roa"] == 1
    assert [(r["valid_from"], r["valid_to"], r["snapshots"]) for r in held.intervals("roa").collect()] == [(DATES[0], DATES[1], 2)]
    assert {r["run_id"]: (r["status"], r["rows"]) for r in Catalog(spark, f"{tmp_path}/catalog").runs().collect()} == {"r1": ("ok", 1), "r2": ("ok", 1)}
