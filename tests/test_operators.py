from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathlight.operators import detectors, explorer, graph, incidents, metrics, origin, relations, replay, runs
from pathlight.session import keep

T0 = datetime(2026, 8, 24)
ELEMENT = "ts timestamp_ntz, seq bigint, collector string, peer_asn bigint, peer_ip string, elem_type string, prefix string, prefix_ip_version int, origin_asn bigint, path array<bigint>, as_path_len int, has_as_set boolean"


def element(minute, kind, prefix, path, peer=1, collector="c1", seq=None):
    path = path if kind != "W" else []
    return (T0 + timedelta(minutes=minute), minute if seq is None else seq, collector, peer, f"10.0.0.{peer}", kind, prefix, 4, path[-1] if path else None, path, len(path), False)


def frame(spark, rows):
    return spark.createDataFrame(rows, ELEMENT)


def test_origin_validation(spark):
    roas = spark.createDataFrame([("197.0.0.0/12", 5, 16)], "prefix string, asn bigint, max_len int")
    pairs = spark.createDataFrame([("197.1.0.0/16", 5), ("197.1.0.0/16", 6), ("197.1.0.0/20", 5), ("8.0.0.0/8", 5), ("197.1.0.0/16", None)], "prefix string, origin_asn bigint")
    got = {(r["prefix"], r["origin_asn"]): r["rpki_status"] for r in origin.validate_rpki(pairs, roas).collect()}
    assert got == {("197.1.0.0/16", 5): "valid", ("197.1.0.0/16", 6): "invalid", ("197.1.0.0/20", 5): "invalid", ("8.0.0.0/8", 5): "not-found", ("197.1.0.0/16", None): "not-found"}


def test_adjacency_uses_first_occurrences(spark):
    rows = frame(spark, [element(0, "A", "p", [174, 3320, 36800, 174, 36700])])
    got = {(r["asn"], r["neighbour"]) for r in metrics.daily_adjacency(rows).collect()}
    assert {b for a, b in got if a == 174} == {3320} and (36700, 174) in got


def test_daily_counts_keep_the_null_origin(spark):
    rows = frame(spark, [element(0, "A", "p", [1, 37100]), element(1, "A", "p", [1, 37100]), element(2, "W", "p", []), element(3, "A", "p", [1, 45090])])
    got = {r["origin_asn"]: (r["announcements"], r["withdrawals"], r["rib_rows"]) for r in metrics.daily_prefix_origin(rows).collect()}
    assert got == {37100: (2, 0, 0), 45090: (1, 0, 0), None: (0, 1, 0)}


@pytest.mark.parametrize("peers, collectors, level", [(5, 2, "high"), (5, 1, "medium"), (3, 1, "medium"), (2, 2, "medium"), (2, 1, "low")])
def test_confidence(spark, peers, collectors, level):
    assert spark.range(1).select(detectors.confidence(F.lit(peers), F.lit(collectors))).first()[0] == level


@pytest.mark.parametrize("score, level", [(0.65, "critical"), (0.64, "watch"), (0.35, "watch"), (0.34, "info")])
def test_severity(spark, score, level):
    assert spark.range(1).select(detectors.severity(F.lit(score))).first()[0] == level


def replayed(rows, at, origin=None, targets=(), warm_up=24):
    """Frames of a replay by a plain state machine: (time, announcements, withdrawals, paths)."""
    rows = sorted((r for r in rows if at.start - timedelta(hours=warm_up) <= r[0] <= at.end), key=lambda r: (r[0], r[1]))
    state, out, i = {}, [], 0
    for k in range(at.last + 1):
        end, counts = min(at.start + k * timedelta(minutes=at.minutes), at.end), [0, 0]
        while i < len(rows) and rows[i][0] <= end:
            r = rows[i]
            counts[r[5] == "W"] += 1
            if r[5] == "W":
                state.pop((r[2], r[4]), None)
            elif r[9]:
                state[r[2], r[4]] = r[9]
            i += 1
        paths = []
        for path in state.values():
            if origin is None or path[-1] == origin:
                path = path[::-1]
                stop = next((n for n, x in enumerate(path) if x in targets), len(path))
                paths.append(tuple(path[: stop + 1]))
        out.append((end, *(counts if k else (0, 0)), paths))
    return out


@pytest.mark.parametrize("seed, minutes, origin, targets", [(1, 60, None, ()), (2, 45, 9, (2,)), (3, 7, 8, (1, 3)), (4, 240, None, (9,))])
def test_replay_matches_the_state_machine(spark, seed, minutes, origin, targets):
    import random

    rng = random.Random(seed)
    rows = [element(rng.randrange(-1700, 300), rng.choice("AAAWR"), "p", [rng.randrange(1, 4), rng.randrange(4, 6), rng.choice([8, 9])], peer=rng.randrange(1, 5), collector=f"c{rng.randrange(2)}", seq=i) for i in range(120)]
    rows += [element(m, "A", "p", [], peer=2, seq=500 + m) for m in (40, 90)]  # no path: nothing changes
    at = replay.span(T0 + timedelta(minutes=30), T0 + timedelta(minutes=290), minutes)
    want = replayed(rows, at, origin, targets)
    elements = frame(spark, rows)
    held = replay.states(elements, "p", at, origin, list(targets)).cache()
    got = {}
    for r in replay.paths(held, at).collect():
        got.setdefault(r["frame"], {})[tuple(r["path"])] = r["peers"]
    for end, _, _, paths in want:
        assert got.get(end, {}) == {x: paths.count(x) for x in paths}, end
    edges = [{e for x in paths for e in zip(x, x[1:])} for *_, paths in want]
    rows = {r["frame"]: (r["announcements"], r["withdrawals"], r["paths"], r["nodes"], r["edges"]) for r in replay.frames(elements, held, "p", at).collect()}
    assert rows == {w[0]: (w[1], w[2], len(set(w[3])), len({n for x in w[3] for n in x}), len(e)) for w, e in zip(want, edges)}
    assert {tuple(r) for r in replay.stable_edges(held, at).collect()} == set.intersection(*edges)
    changed = sorted([(w[0], *e, "added") for w, now, old in zip(want[1:], edges[1:], edges) for e in now - old] + [(w[0], *e, "removed") for w, now, old in zip(want[1:], edges[1:], edges) for e in old - now])
    assert sorted(tuple(r) for r in replay.changes(held, at).collect()) == changed and changed
    apart = sorted([(w[0], *e, "added") for w, now in zip(want, edges) for e in now - edges[0]] + [(w[0], *e, "removed") for w, now in zip(want, edges) for e in edges[0] - now])
    assert sorted(tuple(r) for r in replay.difference(held, at).collect()) == apart
    assert replay.paths(held, at, max_paths=1).isEmpty() and replay.paths(held, at, max_in_frames=3).isEmpty()


def test_replay_spans():
    at = replay.span(T0, T0 + timedelta(days=10), 15)
    assert at.clamped and at.start == T0 + timedelta(days=3) and at.minutes == 51 and at.last <= 200
    assert replay.span(T0, T0 + timedelta(hours=1), 15) == replay.Span(T0, T0 + timedelta(hours=1), 15) and replay.span(T0, T0, 15).last == 0


def test_depths_on_graphs_with_cycles(spark):
    import random

    rng = random.Random(6)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)] + [(50, 51), (51, 50)]
    want, level = {0: 0, 7: 0}, {0, 7}
    while level:
        level = {b for a, b in edges if a in level} - set(want)
        want |= dict.fromkeys(level, max(want.values()) + 1)
    roots = spark.createDataFrame([(0,), (7,), (7,)], "node bigint")
    assert {r["node"]: r["depth"] for r in graph.depths(spark.createDataFrame(edges, "a bigint, b bigint"), roots).collect()} == want and max(want.values()) > 3


def test_incidents_measure_from_the_first_event(spark):
    rows = [("p", T0 + timedelta(minutes=m), "moas" if m < 50 else "bogon", f"e{m}", 0.5, T0 + timedelta(minutes=m + 5)) for m in (0, 50, 65, 130)]
    events = spark.createDataFrame(rows, "prefix string, first_seen timestamp_ntz, detector string, event_id string, score double, last_seen timestamp_ntz")
    got = sorted((r["first_seen"], r["event_ids"], r["score"]) for r in incidents.correlate(events).collect())
    assert [(x[1], x[2]) for x in got] == [(["e0", "e50"], 0.58), (["e65"], 0.5), (["e130"], 0.5)]


EVENT = "prefix string, first_seen timestamp_ntz, detector string, event_id string, score double, last_seen timestamp_ntz"


def folded(rows, minutes):
    """Incidents by the plain fold over each prefix's time line: (prefix, event ids)."""
    out = []
    for prefix in {r[0] or "-" for r in rows}:
        anchor = None
        for r in sorted((r for r in rows if (r[0] or "-") == prefix), key=lambda r: (r[1], r[2], r[3])):
            if anchor is None or r[1] - anchor > timedelta(minutes=minutes):
                anchor = r[1]
                out.append((prefix, []))
            out[-1][1].append(r[3])
    return sorted(out)


@pytest.mark.parametrize("seed, range_hours, spread", [(1, 1, 300), (2, 2, 3_000), (3, 24, 20_000), (4, 1, 60)])
def test_incidents_equal_the_fold(spark, seed, range_hours, spread):
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(400):
        at = T0 + timedelta(minutes=rng.choice([rng.randrange(spread), 60 * rng.randrange(1 + spread // 60)]), microseconds=rng.choice([0, 0, 1]))
        rows.append((rng.choice(["p", "p", "q", None]), at, rng.choice(["moas", "bogon", "leak"]), f"e{i}", rng.random() * 0.7, at + timedelta(minutes=rng.randrange(90))))
    got = incidents.correlate(spark.createDataFrame(rows, EVENT), 60, range_hours).collect()
    assert sorted((r["prefix"], r["event_ids"]) for r in got) == folded(rows, 60)
    by_id = {r[3]: r for r in rows}
    for r in got:
        own = [by_id[e] for e in r["event_ids"]]
        kinds = sorted({e[2] for e in own})
        assert r["detectors"] == kinds and r["first_seen"] == min(e[1] for e in own) and r["last_seen"] == max(e[5] for e in own)
        assert abs(r["score"] - round(min(1.0, max(e[4] for e in own) + min(0.25, 0.08 * (len(kinds) - 1))), 3)) < 1.1e-3
    assert incidents.correlate(spark.createDataFrame([], EVENT)).isEmpty()


def test_a_million_events_of_one_prefix(spark):
    """As many events without a quiet hour: one task never holds more than a range of them, the incidents are the fold's."""
    import numpy as np

    n, step = 1_000_000, 7_300_000  # microseconds from one to the next: a quarter of a year
    events = spark.range(n).select(F.lit("p").alias("prefix"), F.timestamp_micros(F.lit(1787529600000000) + F.col("id") * step + F.pmod(F.col("id") * 7919, F.lit(6_000_000))).cast("timestamp_ntz").alias("first_seen"), F.col("id").alias("event_id"))
    got = incidents.anchored(events, 60, 24).groupBy("anchor").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
    i = np.arange(n, dtype=np.int64)
    times, at, want = 1787529600000000 + i * step + i * 7919 % 6_000_000, 0, []
    while at < n:
        end = int(np.searchsorted(times, times[at] + 3_600_000_000, "right"))
        want.append((int(times[at]), at, end - 1, end - at))
        at = end
    assert [tuple(r) for r in got] == want and len(want) > 2_000
    upper, out = incidents.summarise(times[:12_000], 3_600_000_000, int(times[0]))
    assert len(upper) < 600  # far fewer steps than events


def planted(spark, seed):
    """Days of quiet routing over a random three-level topology, with two anomalies of each kind at random places and times.

    Returns the tables of the detectors and the truth: (prefix, time, detector) of each anomaly.
    """
    import ipaddress
    import random

    rng = random.Random(seed)
    numbers = rng.sample(range(300, 9000), 40)
    tops, regions, owners, strangers = numbers[:3], numbers[3:8], numbers[8:22], numbers[22:30]
    above = {r: rng.sample(tops, 2) for r in regions} | {o: rng.sample(regions, 2) for o in owners + strangers}
    rel = [(up, down, "p2c") for down, ups in above.items() for up in ups] + [(a, b, "p2p") for i, a in enumerate(tops) for b in tops[i + 1 :]]
    peers = [(900_000 + k, f"vantage{k % 3}") for k in range(rng.randrange(8, 12))]
    octets = rng.sample([41, 62, 80, 102, 105, 129, 154, 156, 165, 196, 212], 7)
    space = {o: ipaddress.ip_network(f"{octets[k % 7]}.{16 * (k // 7) + 16}.0.0/{rng.randrange(13, 20)}", strict=False) for k, o in enumerate(owners)}
    rounds = range(0, 24 * rng.randrange(6, 10), 5)
    rows, rib, truth = [], [], []

    def path(peer, origin):
        region = rng.choice(above[origin])
        return [peer, rng.choice(above[region]), region, origin]

    def say(hour, prefix, of, share=1.0, times=1):
        chosen = rng.sample(peers, max(3, int(share * len(peers))))
        for peer, collector in chosen:
            rows.extend(element(hour * 60 + rng.randrange(50), "A", str(prefix), of(peer), peer, collector, len(rows)) for _ in range(times))

    drops = {}
    kinds = ["moas", "subprefix", "valley_free", "churn_spike", "visibility_drop"] * 2
    for kind, owner in zip(kinds, rng.sample(owners, len(kinds))):
        hour, prefix = rng.choice(rounds[8:-2]) + rng.randrange(1, 4), space[owner]
        if kind == "moas":
            thief = rng.choice(strangers)
            say(hour, prefix, lambda peer: path(peer, thief), 0.8)
        elif kind == "subprefix":
            prefix = rng.choice(list(prefix.subnets(new_prefix=prefix.prefixlen + rng.randrange(2, 5))))
            say(hour, prefix, lambda peer: path(peer, owner), 0.9)
        elif kind == "valley_free":  # a region passes what one of its providers said on to the other
            leaker = rng.choice(regions)
            say(hour, prefix, lambda peer: [peer, above[leaker][0], leaker, above[leaker][1], owner], 0.7)
        elif kind == "churn_spike":
            say(hour, prefix, lambda peer: path(peer, owner), 1.0, rng.randrange(20, 30))
        else:
            hour = rng.choice(rounds[8:-2])
            drops[hour, owner] = {peers[0], peers[1]}
        truth.append((str(prefix), T0 + timedelta(hours=hour), kind))
    for hour in rounds:
        for owner, prefix in space.items():
            say(hour, prefix, lambda peer: path(peer, owner), rng.choice([0.4, 0.5, 0.6]))
            for peer, collector in peers:
                if (peer, collector) in drops.get((hour, owner), peers):
                    rib.append((T0 + timedelta(hours=hour), collector, peer, str(prefix), owner, 4))
    snapshots = spark.createDataFrame(rib, "snapshot_ts timestamp_ntz, collector string, peer_asn bigint, prefix string, origin_asn bigint, as_path_len int")
    roas = spark.createDataFrame([(str(n), o, n.prefixlen) for o, n in space.items()], "prefix string, asn bigint, max_len int")
    routes = spark.createDataFrame([], "prefix string, asn bigint")
    links = spark.createDataFrame(rel, "as_a bigint, as_b bigint, relationship string")
    orgs = spark.createDataFrame([(o, f"org{k}") for k, o in enumerate(owners)], "asn bigint, org_id string")
    return (frame(spark, rows), snapshots, roas, routes, links, orgs, spark.createDataFrame([], "prefix string")), truth


@pytest.mark.parametrize("seed", [12, 31])
def test_every_planted_anomaly_is_found(spark, seed):
    (elements, rib, roas, routes, rel, orgs, anycast), truth = planted(spark, seed)
    found = detectors.moas(elements, roas, routes, rel, orgs, anycast)
    for more in (detectors.subprefix(elements, roas, routes), detectors.route_leaks(elements, rel), detectors.churn_spikes(elements), detectors.visibility_drops(rib, elements)):
        found = found.unionByName(more)
    days = spark.createDataFrame([(p, at.date()) for p, at, _ in truth], "prefix string, day date")
    asns = spark.createDataFrame([(1, "KE", True)], "asn bigint, country_iso2 string, is_african boolean")
    events = detectors.finish(found, asns).cache()
    assert incidents.recall(days, events).first()["recall"] == 1.0
    assert {(r["prefix"], r["detector"]) for r in events.collect()} == {(p, kind) for p, _, kind in truth}  # and nothing else
    again = detectors.finish(found, asns)
    assert {r[0] for r in again.select("event_id").collect()} == {r[0] for r in events.select("event_id").collect()}


def test_stable_origins_are_legitimate(spark):
    (elements, rib, roas, routes, rel, orgs, anycast), truth = planted(spark, 12)
    found = detectors.moas(elements, roas, routes, rel, orgs, anycast).select("prefix", F.col("asns")[1].alias("origin_asn")).collect()
    assert sorted(r["prefix"] for r in found) == sorted(p for p, _, kind in truth if kind == "moas")
    stable = spark.createDataFrame([tuple(found[0])], "prefix string, origin_asn bigint")
    left = detectors.moas(elements, roas, routes, rel, orgs, anycast, stable)
    assert [r["prefix"] for r in left.collect()] == [found[1]["prefix"]]


def test_empty_elements_give_empty_tables(spark):
    none = frame(spark, [])
    for out in (metrics.churn_by_prefix(none), metrics.upstreams(none), metrics.path_evolution(none), metrics.daily_adjacency(none), detectors.churn_spikes(none)):
        assert out.isEmpty()


def test_relationship_confidence(spark):
    rel = spark.createDataFrame([(1, 2, "p2c")], "as_a bigint, as_b bigint, relationship string")
    evidence = spark.createDataFrame([(1, 2, ["caida", "ix"])], "as_a bigint, as_b bigint, sources array<string>")
    links = spark.createDataFrame([(2, 1), (3, 4)], "a bigint, b bigint")
    got = {r["a"]: (r["sources"], r["confidence"]) for r in relations.sources(links, evidence, rel).collect()}
    assert got == {2: (["caida", "ix"], "high"), 3: ([], "medium")}


def test_leaks_name_the_leaker_and_are_capped(spark):
    rows = [(f"10.{i}.0.0/16", [1, 2, 3, 4], p) for i in range(2) for p in range(1, 9)]
    elements = spark.createDataFrame([(x, path, peer, "c1" if peer % 2 else "c2", "A", len(path)) for x, path, peer in rows], "prefix string, path array<bigint>, peer_asn bigint, collector string, elem_type string, as_path_len int")
    elements = elements.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    # From the collector: up to 2's provider? no: 1 provides 2 (down), 3 provides 2 (up again).
    relations = spark.createDataFrame([(1, 2, "p2c"), (3, 2, "p2c"), (3, 4, "p2c")], "as_a bigint, as_b bigint, relationship string")
    alone = detectors.route_leaks(elements, relations).collect()
    assert alone and all(len(r["asns"]) == 1 and r["score"] == 0.55 for r in alone)
    leaker = alone[0]["asns"][0]
    evidence = spark.createDataFrame([(a, b, ["caida", "irr"]) for a, b in ((1, 2), (2, 3), (3, 4))], "as_a bigint, as_b bigint, sources array<string>")
    sure = detectors.route_leaks(elements, relations, evidence).collect()
    assert all(r["asns"] == [leaker] and abs(r["score"] - 0.6) < 1e-9 for r in sure)


def test_confidence_falls_where_little_is_observed(spark):
    found = spark.createDataFrame([("10.0.0.0/8", [1], "high", 0.7), ("11.0.0.0/8", [2], "high", 0.7), ("12.0.0.0/8", [1], "low", 0.2)], "prefix string, asns array<bigint>, confidence string, score double")
    found = found.withColumn("detector", F.lit("d")).withColumn("first_seen", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    asns = spark.createDataFrame([(1, "KE", True), (2, "TN", True)], "asn bigint, country_iso2 string, is_african boolean")
    coverage = spark.createDataFrame([("KE", 0.1), ("TN", 0.3)], "country_iso2 string, coverage_ratio double")
    got = {r["prefix"]: (r["confidence"], r["severity"]) for r in detectors.finish(found, asns, coverage).collect()}
    assert got == {"10.0.0.0/8": ("medium", "critical"), "11.0.0.0/8": ("high", "critical"), "12.0.0.0/8": ("low", "info")}


def test_a_failing_detector_leaves_the_others_alone(spark, tmp_path):
    asns = spark.createDataFrame([(1, "KE", True)], "asn bigint, country_iso2 string, is_african boolean")
    row = spark.createDataFrame([("10.0.0.0/8", [1], "high", 0.7, "d")], "prefix string, asns array<bigint>, confidence string, score double, detector string")
    row = row.withColumn("first_seen", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).withColumn("last_seen", F.col("first_seen"))
    found = {"good": lambda: row, "bad": lambda: row.select(F.raise_error(F.lit("no data")).alias("x")), "worse": lambda: row.select("nothing"), "off": lambda: row}
    got = runs.run(spark, found, str(tmp_path), "r1", asns, disabled=frozenset({"off"}))
    assert got["good"] == 1 and got["incidents"] == 1 and set(got) == {"good", "bad", "worse", "incidents"} and "nothing" in got["worse"]
    assert runs.run(spark, {"good": lambda: row}, str(tmp_path), "r2", asns)["good"] == 1


def test_runs_over_other_days_keep_earlier_events(spark, tmp_path):
    asns = spark.createDataFrame([(1, "KE", True)], "asn bigint, country_iso2 string, is_african boolean")

    def candidates(day, score=0.7, detector="d"):
        row = spark.createDataFrame([("10.0.0.0/8", [1], "high", score, detector)], "prefix string, asns array<bigint>, confidence string, score double, detector string")
        return lambda: row.withColumn("first_seen", F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp_ntz")).withColumn("last_seen", F.col("first_seen"))

    folder = str(tmp_path)
    runs.run(spark, {"d": candidates(1)}, folder, "r1", asns)
    runs.run(spark, {"d": candidates(2)}, folder, "r2", asns)
    held = lambda: sorted((str(r["first_seen"])[:10], r["score"]) for r in runs.events(spark, folder).collect())
    assert held() == [("2024-01-01", 0.7), ("2024-01-02", 0.7)] and runs.incidents_of(spark, folder).count() == 2
    report = runs.run(spark, {"d": candidates(1, 0.4), "e": lambda: candidates(1)().select("nothing")}, folder, "r3", asns)  # the same event again, and a failure
    assert held() == [("2024-01-01", 0.4), ("2024-01-02", 0.7)] and report["incidents"] == 2
    runs.run(spark, {"d": candidates(3)}, folder, "r4", asns, disabled=frozenset({"d"}))
    assert len(held()) == 2 and runs.incidents_of(spark, folder).count() == 2
    runs.run(spark, {"d": candidates(4)}, folder, "r4", asns)  # the run started again
    assert len(held()) == 3 and runs.incidents_of(spark, folder).count() == 3


def joins(df):
    """Whether the plan that was run has joins by broadcast, and by merging."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "BroadcastHashJoin" in plan, "SortMergeJoin" in plan


def test_growing_sides_of_joins_are_not_broadcast(spark):
    """Their compressed size says little of their size in the driver's memory (F1)."""
    pairs = spark.createDataFrame([("197.1.0.0/16", 5), ("8.0.0.0/8", 6)], "prefix string, origin_asn bigint")
    roas, routes = spark.createDataFrame([("197.0.0.0/12", 5, 16)], "prefix string, asn bigint, max_len int"), spark.createDataFrame([("8.0.0.0/8", 6)], "prefix string, asn bigint")
    for found in (keep(pairs).join(pairs, "prefix"), origin.validate_rpki(pairs, roas), origin.validate_irr(pairs, routes), origin.validate(pairs, roas, routes)):
        assert joins(found) == (False, True)


def test_relations_are_merged_with_neighbours_and_links(spark):
    """A registry's relations in both directions take more than a GB of the driver where they are many (F4)."""
    links = spark.createDataFrame([(1, 2, "p2c"), (2, 3, "p2p")], "as_a bigint, as_b bigint, relationship string")
    paths = spark.createDataFrame([([3, 2, 1],)], "path array<bigint>")
    assert joins(relations.classify_paths(paths, links)) == (False, True)
    days = spark.createDataFrame([(T0, 4, 2, 1), (T0, 4, 2, 3), (T0, 4, 2, 9), (T0, 4, 3, 2)], "day timestamp_ntz, ip_version int, asn bigint, neighbour bigint")
    series = explorer.neighbour_series(days, spark.createDataFrame([(2,)], "asn bigint"), links)
    assert [tuple(r)[1:] for r in series.collect()] == [(1, 0, 1, 1)]
    joins(series)
    merge = [line for line in series._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in line and "neighbour" in line]
    assert merge


def anycast_paths(spark, alike):
    """Two origins of a prefix of the catalogue with eight paths each; the last ones are the same but for the origin where they are ``alike``."""
    last = [99, 50, 51]
    rows = [element(i, "A", "197.32.0.0/12", [20 + i, 30 + i, 7], peer=i % 4 + 1) for i in range(8)] + [element(30, "A", "197.32.0.0/12", [*last, 7], peer=1)]
    rows += [element(40 + i, "A", "197.32.0.0/12", [60 + i, 70 + i, 8], peer=i % 4 + 1) for i in range(7)] + [element(60, "A", "197.32.0.0/12", [*(last if alike else (98, 52, 53)), 8], peer=1)]
    return frame(spark, rows)


@pytest.mark.parametrize("alike", [True, False])
def test_all_paths_of_anycast_origins_are_compared(spark, alike):
    """The first five paths of each origin were compared alone (F1)."""
    none = lambda columns: spark.createDataFrame([], columns)
    catalogue = spark.createDataFrame([("197.0.0.0/8",)], "prefix string")
    found = detectors.moas(anycast_paths(spark, alike), none("prefix string, asn bigint, max_len int"), none("prefix string, asn bigint"), none("as_a bigint, as_b bigint, relationship string"), none("asn bigint, org_id string"), catalogue)
    assert [r["asns"] for r in found.collect()] == ([[7, 8]] if alike else [])


@pytest.mark.parametrize("seed, ceiling", [(1, 0.0), (2, 0.3), (3, 0.5), (4, 0.6), (5, 0.75), (6, 1.0)])
def test_divergent_origins_equal_the_comparison_of_all_pairs(spark, seed, ceiling):
    import random

    rng = random.Random(seed)
    rows, pairs = [], []
    for k in range(60):
        numbers = range(10, 10 + rng.choice([8, 20, 60]))
        for origin_asn in (1, 2, 3):  # the second may have paths that are an origin alone, the third may have none
            size = lambda: rng.randrange(0 if origin_asn == 2 else 1, rng.choice([3, 5, 8]))
            rows += [element(0, "A", f"p{k}", [*rng.choices(numbers, k=size()), origin_asn]) for _ in range(rng.randrange(0 if origin_asn == 3 else 1, 9))]
        pairs += [(f"p{k}", 1, 2), (f"p{k}", 1, 3), (f"p{k}", 2, 3)]
    want = set()
    for prefix, a, b in pairs:
        one, other = ([set(r[9][:-1]) for r in rows if r[6] == prefix and r[8] == x] for x in (a, b))
        if one and other and max(len(x & y) / len(x | y) if x | y else 0.0 for x in one for y in other) <= ceiling:
            want.add((prefix, a, b))
    got = origin.divergent(spark.createDataFrame(pairs, "prefix string, incumbent bigint, origin_asn bigint"), frame(spark, rows), ceiling)
    assert {tuple(r) for r in got.collect()} == want and 0 < len(want) < len(pairs)
