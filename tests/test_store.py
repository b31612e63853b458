"""The metric store: stored days and computed days give the same rows, and only current days are taken."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathlight.operators import explorer, metrics, store as stores
from pathlight.sources import tables

ELEMENT = "ts timestamp_ntz, collector string, peer_asn bigint, peer_ip string, elem_type string, prefix string, prefix_ip_version int, prefix_len int, origin_asn bigint, path array<bigint>, as_path_len int, has_as_set boolean"


def elements(spark, days, seed=1, n=60):
    rng, rows = random.Random(seed), []
    for day in days:
        for _ in range(n):
            kind, v6 = rng.choice("AAAWR"), rng.random() < 0.3
            origin = rng.randrange(11, 15)
            path = [] if kind == "W" else [rng.randrange(1, 4), rng.randrange(5, 8), origin]
            prefix = f"2c0f:{rng.randrange(1, 5)}::/32" if v6 else f"41.{rng.randrange(6)}.0.0/16"
            rows.append((datetime(2025, 3, day) + timedelta(minutes=rng.randrange(1440)), f"c{rng.randrange(2)}", rng.randrange(1, 4), f"10.0.0.{rng.randrange(3)}", kind, prefix, 6 if v6 else 4, 32 if v6 else 16, path[-1] if path else None, path, len(path), False))
    return spark.createDataFrame(rows, ELEMENT)


def write_rib(rows, path):
    rib = rows.where("elem_type = 'R'").withColumn("snapshot_ts", F.date_trunc("day", "ts").cast("timestamp_ntz")).withColumn("date", F.to_date("ts"))
    rib.write.mode("append").partitionBy("date").parquet(path)


@pytest.fixture
def held(spark, tmp_path):
    rows = elements(spark, range(1, 4))
    paths = {name: str(tmp_path / name) for name in ("elements", "rib")}
    tables.write_elements(rows, paths["elements"])
    write_rib(rows, paths["rib"])
    asns = spark.createDataFrame([(11, "KE", True), (12, "KE", True), (13, "ZA", True), (14, "FR", False), (5, "ZA", True)], "asn bigint, country_iso2 string, is_african boolean")
    roas = spark.createDataFrame([("41.0.0.0/16", 11, 16), ("2c0f:1::/32", 12, 48)], "prefix string, asn bigint, max_len int")
    roles = spark.createDataFrame([("c0", "external")], "collector string, role string")
    return stores.Store(spark, str(tmp_path / "metrics"), paths, asns, roas, roles, window="6h", max_age=0.0)


def same(a, b):
    columns = sorted(b.columns)
    # Counts and shares are exact; means of doubles may differ in the last place.
    text = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(columns).collect())
    return sorted(a.columns) == columns and text(a) == text(b)


def test_every_table_is_the_same_stored_and_computed(held):
    computed = {name: held.table(name) for name in stores.TABLES}
    assert not any(held.current(name) for name in stores.TABLES)
    written = held.build(["2025-03-02", "2025-03-03"], run_id="r")
    for name in stores.TABLES:
        assert held.current(name) == {"2025-03-02", "2025-03-03"}
        rows = held.table(name)  # two stored days and a computed one
        assert same(rows, computed[name]), name
        assert rows.where("day >= '2025-03-02'").count() == written[name] > 0, name


def test_days_by_themselves_equal_the_whole_of_one_day(held):
    day = held.days()[2]
    inputs = held._inputs([day])
    assert same(held.table("coverage", day, day).drop("day"), metrics.coverage(inputs.elements, inputs.asns))
    assert same(held.table("rpki_coverage", day, day).drop("day"), metrics.rpki_coverage(inputs.elements, inputs.asns, inputs.roas))
    assert same(held.table("country", day, day).drop("day"), metrics.country(inputs.elements, inputs.rib, inputs.asns, inputs.roles, "6h"))


def files(df):
    """(table, date) of the files that a plan reads."""
    parts = [x.split("/") for x in df.inputFiles()]
    return {(next(y for y in x if y in {"elements", "rib", *stores.TABLES}), next(y for y in x if y.startswith("date=")).removeprefix("date=")) for x in parts}


def test_current_days_are_not_scanned(held):
    days = ["2025-03-01", "2025-03-02", "2025-03-03"]
    held.build(names=["daily_prefix_origin"])
    assert files(held.table("daily_prefix_origin")) == {("daily_prefix_origin", d) for d in days}
    assert {d for _, d in files(held.table("upstream", days[1], days[1]))} == {days[1]}


def test_a_changed_day_is_computed_again(held, spark):
    names = ["daily_prefix_origin", "visibility"]
    held.build(names=names)
    late = elements(spark, [3], seed=9, n=5)
    late.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date", "collector").parquet(held.paths["elements"])
    assert held.current("daily_prefix_origin") == set(held.days()) - {"2025-03-03"} and held.current("visibility") == set(held.days())
    table = held.table("daily_prefix_origin")
    assert table.agg(F.sum(F.col("announcements") + F.col("withdrawals") + F.col("rib_rows"))).first()[0] == 3 * 60 + 5
    assert files(table) == {("daily_prefix_origin", "2025-03-01"), ("daily_prefix_origin", "2025-03-02"), ("elements", "2025-03-03")}
    held.build(["2025-03-03"], names)
    assert held.current("daily_prefix_origin") == set(held.days())


def test_a_build_that_ends_early_changes_nothing(held, monkeypatch):
    held.build(names=["daily_adjacency"])
    before, ledger = held.table("daily_adjacency").collect(), sorted(map(str, held.ledger().collect()))

    def fail(_):
        raise OSError("no room")

    monkeypatch.setitem(stores.TABLES, "churn_asn", stores.Table(("elements",), fail, ("origin_asn",)))
    with pytest.raises(OSError):
        held.build(names=["churn_asn"])
    # A build whose rows are written but whose ledger isn't.
    monkeypatch.setattr(stores.Store, "_states", lambda self: {("daily_adjacency", "2025-03-01"): (1, 1)})
    monkeypatch.setattr(stores, "datetime", None)
    with pytest.raises(AttributeError):
        held.build(["2025-03-01"], ["daily_adjacency"])
    monkeypatch.undo()
    assert sorted(map(str, held.ledger().collect())) == ledger
    assert sorted(map(str, held.table("daily_adjacency").collect())) == sorted(map(str, before))


def test_old_versions_go(held):
    held.build(names=["coverage"])
    held.build(["2025-03-01"], ["coverage"])
    assert held.vacuum() == 0  # the first version still has the other days
    held.build(names=["coverage"])
    assert held.vacuum() == 2 and held.table("coverage").count() == 6


def test_builds_are_recorded(held, spark):
    held.build(["2025-03-01"], ["coverage"], run_id="r7")
    catalog = stores.Catalog(spark, f"{held.folder}/catalog")
    assert [(r["run_id"], r["status"], r["rows"]) for r in catalog.runs().collect()] == [("r7", "ok", 2)]
    assert [(r["name"], r["rows"]) for r in catalog.registered().collect()] == [("coverage/2025-03-01/", 2)]


def test_lists_take_either_source(held):
    daily, asns = held.table("daily_prefix_origin"), held._references["asns"]
    raw = [explorer.asn_list(daily, asns).collect(), explorer.prefix_list(daily).collect(), explorer.prefix_list(daily, ip_version=6, least_updates=10).collect()]
    held.build(names=["daily_prefix_origin"])
    daily = held.table("daily_prefix_origin")
    assert [explorer.asn_list(daily, asns).collect(), explorer.prefix_list(daily).collect(), explorer.prefix_list(daily, ip_version=6, least_updates=10).collect()] == raw
    rows = held._inputs(held.days()).elements.where("elem_type <> 'R'").groupBy("prefix").agg(F.count("*").alias("n"), F.max("ts").alias("at"), F.expr("mode() within group (order by origin_asn)").alias("o"), F.count_distinct("origin_asn").alias("k"))
    want = sorted(((r["prefix"], r["n"], r["o"], r["k"], r["at"]) for r in rows.collect()), key=lambda r: (-r[1], r[0]))
    assert [(r["prefix"], r["updates"], r["origin_asn"], r["origins"], r["last_seen"]) for r in raw[1]] == want
    assert [r["prefix"] for r in raw[2]] == [r[0] for r in want if ":" in r[0] and r[1] >= 10]


def test_families_are_asked_by_themselves(held, spark):
    daily, adjacency = held.table("daily_prefix_origin"), held.table("daily_adjacency")
    origins, none = spark.createDataFrame([(11,)], "asn bigint"), spark.createDataFrame([], "prefix string, asn bigint, max_len int")
    both, four, six = (explorer.prefix_table(daily, origins, none, none.drop("max_len"), v).select("prefix").collect() for v in (None, 4, 6))
    assert len(four) and len(six) and len(both) == len(four) + len(six) and all(":" in r[0] for r in six)
    relations = spark.createDataFrame([], "as_a bigint, as_b bigint, relationship string")
    table = explorer.neighbour_table(adjacency, origins, relations, held._references["asns"], 6)
    assert table.count() and {(r["v4"], r["v6"]) for r in table.collect()} == {(False, True)}


def test_a_failing_catalog_read_is_no_empty_catalog(spark, tmp_path):
    held = stores.Catalog(spark, str(tmp_path / "catalog"))
    assert held.ingested().isEmpty() and held.runs().isEmpty()
    folder = tmp_path / "catalog" / "ingested"
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception, match="part-0.parquet"):
        held.ingested().collect()
