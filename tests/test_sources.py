import json

import pytest
from pyspark.sql import functions as F

from pathlight.sources import catalog, readers, tables
from pathlight.streaming import live

LIVE = [
    {"timestamp": 1787533200.5, "peer": "196.60.1.5", "peer_asn": "174", "path": ["174", "3320", "37100"], "host": "rrc19.net", "announcements": [{"next_hop": "1.1.1.1", "prefixes": ["197.155.64.0/22", "bad"]}], "withdrawals": []},
    {"timestamp": 1787533260.0, "peer": "196.60.1.5", "peer_asn": "174", "path": [], "host": "rrc19.net", "announcements": [], "withdrawals": ["197.155.64.0/22"]},
]


def live_file(folder, name="a.json", rows=LIVE):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([*map(json.dumps, rows), "{not json"]))
    return str(folder)


def test_live_messages(spark, tmp_path):
    got = readers.read_live(spark, live_file(tmp_path / "in")).orderBy("ts").collect()
    assert [(r["elem_type"], r["prefix"], r["origin_asn"], r["as_path_len"]) for r in got] == [("A", "197.155.64.0/22", 37100, 3), ("W", "197.155.64.0/22", None, 0)]
    assert got[0]["collector"] == "rrc19"


def test_table_dump(spark, tmp_path):
    text = (
        "   Network          Next Hop            Metric LocPrf Weight Path\n"
        "*> 1.0.0.0/24       192.0.2.1                0             0 174 13335 i\n"
        "*                   192.0.2.2                              0 3320 {1,2} 13335 ?\n"
        "*> 8.0.0.0          192.0.2.1                0             0 174 3356 i\n"
    )
    (tmp_path / "dump.txt").write_text(text)
    got = readers.read_table_dump(spark, str(tmp_path / "dump.txt"), "pch", "2026-08-24 00:00:00").collect()
    assert sorted((r["prefix"], r["peer_asn"], r["origin_asn"], r["has_as_set"]) for r in got) == [("1.0.0.0/24", 174, 13335, False), ("1.0.0.0/24", 3320, 13335, True), ("8.0.0.0/8", 174, 3356, False)]


def test_reference_files(spark, tmp_path):
    (tmp_path / "d").write_text("2|afrinic|x\nafrinic|KE|asn|37100|2|20100101|allocated|x\nafrinic|KE|ipv4|1.0.0.0|256|20100101|allocated|x\nafrinic|ZA|asn|5|1|20100101|reserved|x\n")
    one = readers.read_delegated(spark, str(tmp_path / "d"), "afrinic")
    assert sorted(r["asn"] for r in one.collect()) == [37100, 37101]
    two = spark.createDataFrame([(37100, "FR", "ripe", "x"), (9, "ZA", "ripe", "x")], one.schema)
    assert {r["asn"]: (r["rir"], r["is_african"]) for r in readers.build_registry([one, two], ["ZA"], "d").collect()} == {37100: ("afrinic", True), 37101: ("afrinic", True), 9: ("ripe", True)}
    (tmp_path / "roa").write_text(json.dumps({"roas": [{"prefix": "1.0.0.0/24", "maxLength": 24, "asn": "AS5", "ta": "a"}, {"prefix": "2.0.0.0/16", "asn": "6"}, {"prefix": "x", "asn": "7"}]}))
    assert sorted((r["prefix"], r["asn"], r["max_len"]) for r in readers.read_roas(spark, str(tmp_path / "roa")).collect()) == [("1.0.0.0/24", 5, 24), ("2.0.0.0/16", 6, 16)]
    (tmp_path / "rel").write_text("# c\n1|2|-1\n3|4|0|x\n")
    assert sorted(tuple(r) for r in readers.read_relationships(spark, str(tmp_path / "rel")).collect()) == [(1, 2, "p2c"), (3, 4, "p2p")]
    (tmp_path / "org").write_text("# format:aut|changed|aut_name|org_id|opaque|source\n5|x|NAME|O1|q|s\n# format:org_id|changed|org_name|country|source\nO1|x|Org One|KE|s\n")
    assert [tuple(r) for r in readers.read_organisations(spark, str(tmp_path / "org")).collect()] == [(5, "NAME", "O1", "Org One")]
    (tmp_path / "any").write_text("1.0.0.0/24,x\nnope,y\n")
    assert [r[0] for r in readers.read_anycast(spark, str(tmp_path / "any")).collect()] == ["1.0.0.0/24"]
    objects = {"objects": {"object": [{"attributes": {"attribute": [{"name": "route", "value": "1.0.0.0/24"}, {"name": "origin", "value": "AS5"}, {"name": "source", "value": "RIPE"}]}}]}}
    (tmp_path / "irr").write_text(json.dumps(objects))
    assert [tuple(r) for r in readers.read_irr_objects(spark, str(tmp_path / "irr")).collect()] == [("1.0.0.0/24", 5, "RIPE")]
    assert readers.archive_times(spark, "2026-08-24 00:07:00", "2026-08-24 00:20:00", 5).count() == 4


def test_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(tables.DataUnavailable):
        tables.read_partitions(spark, path)
    rows = readers.read_live(spark, live_file(tmp_path / "in"))
    tables.write_elements(rows, path)
    tables.write_elements(rows, path)
    got = tables.read_partitions(spark, path, collectors=["rrc19"])
    assert got.count() == 2 and set(rows.columns) <= set(got.columns)
    with pytest.raises(tables.DataUnavailable):
        tables.read_partitions(spark, path, first="2030-01-01")


def test_merge_keeps_the_new_row(spark):
    old = spark.createDataFrame([(1, "c", 1, "i", "A", "p", "old"), (2, "c", 1, "i", "A", "p", "old")], "ts int, collector string, peer_asn int, peer_ip string, elem_type string, prefix string, v string")
    new = spark.createDataFrame([(1, "c", 1, "i", "A", "p", "new")], old.schema)
    assert sorted((r["ts"], r["v"]) for r in tables.merge_window(old, new).collect()) == [(1, "new"), (2, "old")]


def aged(folder, name, rows, seconds):
    """A file of messages that arrived so many seconds after an hour."""
    import os

    live_file(folder, name, rows)
    os.utime(folder / name, (1787533200 + seconds, 1787533200 + seconds))


def message(origin, k=0, pad=0):
    return {**LIVE[0], "path": ["174"] * (pad + 1) + [str(origin)], "announcements": [{"next_hop": "1.1.1.1", "prefixes": [f"197.155.{64 + k}.0/24"]}]}


def test_the_later_file_counts_whatever_its_size(spark, tmp_path):
    folder = tmp_path / "in"
    # Scans pack large files first: here the older file is the small one for prefix 0, the large one for prefix 1.
    aged(folder, "a.json", [message(1, 0)], 0)
    aged(folder, "b.json", [message(2, 0), message(7, 1), *[message(9, 2, 50)] * 300], 60)
    aged(folder, "c.json", [message(8, 1)], 120)
    got = tables.merge_window(None, readers.read_live(spark, str(folder)))
    assert {r["prefix"]: r["origin_asn"] for r in got.collect()} == {"197.155.64.0/24": 2, "197.155.65.0/24": 8, "197.155.66.0/24": 9}


def test_the_last_of_a_file_counts_and_an_older_file_changes_nothing(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "table")
    aged(folder, "b.json", [message(n) for n in (3, 4, 5)], 60)
    tables.swap(tables.merge_window(None, readers.read_live(spark, str(folder))), path)
    assert [r["origin_asn"] for r in tables.read_partitions(spark, path).collect()] == [5]
    for name, origin, seconds, want in (("late.json", 6, 0, 5), ("new.json", 7, 90, 7)):
        other = tmp_path / name
        aged(other, name, [message(origin)], seconds)
        stored = tables.read_partitions(spark, path).drop("date")
        assert tables.swap(tables.merge_window(stored, readers.read_live(spark, str(other))), path) == ["date=2026-08-24/collector=rrc19"]
        assert [r["origin_asn"] for r in tables.read_partitions(spark, path).collect()] == [want]


@pytest.mark.parametrize("step", ["staged", "journal", "moved away", "one of two"])
def test_a_swap_that_is_stopped_loses_nothing(spark, tmp_path, monkeypatch, step):
    path = tmp_path / "t"
    tables.write_elements(elements(spark, [(d, "c", "A", "10.0.0.0/8", d) for d in (1, 2)]), str(path))
    new = elements(spark, [(d, "c", "A", "10.0.0.0/8", 10 + d) for d in (1, 2)])

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tables, "_commit" if step == "staged" else "_finish", stop)
        with pytest.raises(KeyboardInterrupt):
            tables.swap(new, str(path))
    held = lambda: sorted(r["origin_asn"] for r in spark.read.parquet(str(path)).collect())
    assert held() == [1, 2]  # what stands beside the table isn't read
    for day in {"moved away": (1,), "one of two": (1,)}.get(step, ()):
        token = next(path.glob("_journal-*")).name.removeprefix("_journal-")
        (path / f"_old-{token}" / f"date=2024-01-0{day}").mkdir(parents=True)
        (path / f"date=2024-01-0{day}" / "collector=c").rename(path / f"_old-{token}" / f"date=2024-01-0{day}" / "collector=c")
        if step == "one of two":
            (path / f"_staging-{token}" / f"date=2024-01-0{day}" / "collector=c").rename(path / f"date=2024-01-0{day}" / "collector=c")
    assert tables.recover(spark, str(path)) == (step != "staged") and tables.recover(spark, str(path)) == 0
    assert held() == ([1, 2] if step == "staged" else [11, 12])
    assert step == "staged" or not list(path.glob("_*-*"))


def test_two_swaps_share_no_name(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.swap(elements(spark, [(1, "c", "A", "10.0.0.0/8", 1)]), path)
    rows = spark.read.parquet(path).drop("date")
    assert tables.swap(rows.unionByName(elements(spark, [(2, "c", "A", "10.0.0.0/8", 2)])), path) == ["date=2024-01-01/collector=c", "date=2024-01-02/collector=c"]
    assert spark.read.parquet(path).count() == 2


def test_a_look_up_reads_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "t"
    rows = spark.range(60_000).select(
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), F.lit("c").alias("collector"), F.concat(F.lit("10."), (F.col("id") % 200).cast("string"), F.lit(".0.0/16")).alias("prefix"),
        F.sha2(F.col("id").cast("string"), 256).alias("filler"),
    )
    tables.write_elements(rows, str(path), max_rows=10_000_000, row_group=200_000)
    groups, held = 0, 0
    for file in path.rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index("prefix")
        for k in range(meta.num_row_groups):
            column = meta.row_group(k).column(at)
            groups += 1
            held += column.statistics.min <= "10.77.0.0/16" <= column.statistics.max
    assert groups >= 5 and held <= 3
    assert spark.read.parquet(str(path)).where("prefix = '10.77.0.0/16'").count() == 300


def test_compaction_splits_large_partitions_by_ranges(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(3):
        elements(spark, [(1, "c", "A", f"{i}.0.0.0/8", i) for i in range(k + 1, 31, 3)]).coalesce(1).withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date", "collector").parquet(path)
    assert tables.compact(spark, path, file_rows=12) == 0  # thirty rows need three files
    assert tables.compact(spark, path, file_rows=20) == 1 and tables.compact(spark, path, file_rows=20) == 0
    spans = sorted((r["a"], r["b"]) for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("prefix").alias("a"), F.max("prefix").alias("b")).collect())
    assert len(spans) == 2 and spans[0][1] < spans[1][0] and spark.read.parquet(path).count() == 30


def test_curation_and_merging_record_partitions(spark, tmp_path):
    held = catalog.Catalog(spark, str(tmp_path / "catalog"))
    parsed = elements(spark, [(d, "c0", kind, "10.0.0.0/8", 7) for d in (1, 2, 3) for kind in "AR"])
    tables.curate(spark, parsed, str(tmp_path / "e"), str(tmp_path / "rib"), first="2024-01-02", last="2024-01-03", catalog=held)
    live._merge_batch(str(tmp_path / "e"), catalog=held)(elements(spark, [(3, "c0", "A", "11.0.0.0/8", 8)]), 0)
    got = {r["name"]: (r["rows"], r["bytes"] > 0) for r in held.registered().collect()}
    assert got == {"elements/2024-01-02/c0": (1, True), "elements/2024-01-03/c0": (2, True), "rib_snapshots/2024-01-02/c0": (1, True), "rib_snapshots/2024-01-03/c0": (1, True)}


def test_windows_by_arrival(spark, tmp_path):
    folder = tmp_path / "in"
    for k, seconds in enumerate((0, 299, 300, 1000)):
        aged(folder, f"{k}.json", [message(k, k)], seconds)
    live.land(live.live_stream(spark, str(folder)), str(tmp_path / "landed"), str(tmp_path / "check")).awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "landed")).collect():
        got.setdefault(str(r["window"]), set()).add(r["origin_asn"])
    assert got == {"202608240100": {0, 1}, "202608240105": {2}, "202608240115": {3}}


def test_stream_is_idempotent(spark, tmp_path):
    folder, path = live_file(tmp_path / "in"), str(tmp_path / "table")
    for run in ("a", "b"):  # the second starts over: everything arrives again
        live.merge_into(live.live_stream(spark, folder), path, str(tmp_path / f"check-{run}")).awaitTermination()
    assert tables.read_partitions(spark, path).count() == 2


def live_changes(spark, tmp_path, batches, **how):
    """Changes of live state over micro-batches of (minute, peer, path or None) messages, one file each."""
    folder = tmp_path / "in"
    for k, batch in enumerate(batches):
        rows = []
        for minute, peer, path in batch:
            rows.append({**LIVE[0], "timestamp": 1787533200.0 + minute * 60, "peer": peer, "path": path.split() if path else [], "announcements": [{"next_hop": "1.1.1.1", "prefixes": ["10.1.0.0/16"]}] if path is not None else [], "withdrawals": [] if path is not None else ["10.1.0.0/16"]})
        aged(folder, f"{k}.json", rows, k)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        name = f"state_{tmp_path.name}"
        stream = live.live_state(live.live_stream(spark, str(folder), 1), **how)
        stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return [((r["micros"] // 60_000_000) - 1787533200 // 60, r["peer_ip"], r["path"], r["reason"]) for r in spark.table(name).collect()]


def test_live_state_in_order_of_time(spark, tmp_path):
    batches = [
        [(3, "a", "174 2 9"), (1, "a", "174 1 9")],  # out of order within a file
        [(2, "a", None), (4, "b", "3 9"), (4, "b", "4 9")],  # over files; the later of equal times counts
        [(20, "c", "5 9")],  # the watermark passes minute 10
        [(0, "a", "8 9"), (21, "a", ""), (22, "a", None)],  # too late; without a path
        [(60, "c", "5 9"), (61, "c", "5 9")],  # no change
        [(90, "d", "1 9")],
    ]
    got = live_changes(spark, tmp_path, batches)
    assert [x for x in got if x[1] == "a"] == [(1, "a", "174 1 9", "announced"), (2, "a", "", "withdrawn"), (3, "a", "174 2 9", "announced"), (22, "a", "", "withdrawn")]
    b = [x for x in got if x[1] == "b"]
    assert len(b) == 1 and b[0][0] == 4 and b[0][2] in ("3 9", "4 9")  # one file has no order beyond its blocks
    assert [x for x in got if x[1] == "c"] == [(20, "c", "5 9", "announced")]


def test_silent_peers_lose_their_path(spark, tmp_path):
    batches = [[(0, "a", "1 9"), (0, "b", "2 9")], [(50, "b", "2 9")], [(100, "c", "3 9")], [(200, "c", "3 9")], [(201, "c", "3 9")]]
    got = live_changes(spark, tmp_path, batches, silence_ms=3_600_000)
    assert [x for x in got if x[1] == "a"] == [(0, "a", "1 9", "announced"), (0, "a", "", "silent")]
    assert [x for x in got if x[1] == "b"] == [(0, "b", "2 9", "announced"), (50, "b", "", "silent")]


def test_as_sets(spark, tmp_path):
    import random

    from pathlight.operators import as_sets

    objects = {"objects": {"object": [{"attributes": {"attribute": [{"name": "as-set", "value": "AS-A"}, {"name": "members", "value": "AS1, as2,AS-B"}, {"name": "members", "value": " AS3 "}]}}, {"attributes": {"attribute": [{"name": "as-set", "value": "as-b"}, {"name": "members", "value": "AS4"}, {"name": "members", "value": "AS-A"}]}}]}}
    (tmp_path / "sets").write_text(json.dumps(objects))
    members = readers.read_as_sets(spark, str(tmp_path / "sets"))
    assert sorted(map(tuple, members.collect())) == [("AS-A", "AS-B"), ("AS-A", "AS1"), ("AS-A", "AS2"), ("AS-A", "AS3"), ("AS-B", "AS-A"), ("AS-B", "AS4")]
    rng = random.Random(3)
    pairs = [(f"AS-{rng.randrange(20)}", rng.choice([f"AS{rng.randrange(60)}", f"AS-{rng.randrange(24)}", "RS-X"])) for _ in range(90)] + [("AS-0", "AS-0")]
    roots, frame = [f"AS-{i}" for i in range(0, 24, 2)], spark.createDataFrame(pairs, "as_set string, member string")
    for depth in (1, 2, None):
        want = {}
        for root in roots:
            level, seen, n = {root}, {root}, 0
            while level and (depth is None or n < depth):
                n += 1
                met = {m for s, m in pairs if s in level}
                for m in met:
                    if m[2:].isdigit():
                        want.setdefault((root, int(m[2:])), n)
                level = {m for m in met if not m[2:].isdigit()} - seen
                seen |= level
        got = {(r["as_set"], r["asn"]): r["depth"] for r in as_sets.expand(spark.createDataFrame([(r,) for r in roots], "as_set string"), frame, depth).collect()}
        assert got == want and (depth != None or max(want.values()) > 2)  # noqa: E711


def test_catalog(spark, tmp_path):
    held = catalog.Catalog(spark, str(tmp_path / "catalog"))
    assert held.runs().isEmpty()
    with held.run("r1", "curate") as state:
        state["rows"] = 7
    with pytest.raises(ValueError):
        with held.run("r2", "curate"):
            raise ValueError("x")
    assert {r["run_id"]: (r["status"], r["rows"]) for r in held.runs().collect()} == {"r1": ("ok", 7), "r2": ("failed", 0)}
    held.record_file("u", "c", "rib", "failed", 0)
    held.record_file("u", "c", "rib", "ok", 9)
    assert held.ingested().first()["attempts"] == 2 and held.coverage().first()["failed"] == 0


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a;"b"', None), (2, "é\tx", 0.5)], "id int, `x;y` string, v double")
    readers.export_csv(rows, str(tmp_path / "csv"))
    held = [x.read_bytes() for x in (tmp_path / "csv").glob("*.txt") if x.stat().st_size]
    assert held and all(x.startswith('\ufeff"id";"x;y";"v"\n'.encode()) for x in held)
    assert sorted(line for x in held for line in x.decode().splitlines()[1:]) == ['"1";"a;""b""";""', '"2";"é\tx";"0.5"']


def mrt_record(kind, subtype, body, seconds=1787533200):
    import struct

    return struct.pack(">IHHI", seconds, kind, subtype, len(body)) + body


def test_mrt(spark, tmp_path):
    import gzip
    import struct

    from pathlight.sources import mrt

    path = bytes([2, 2]) + struct.pack(">II", 174, 37100) + bytes([1, 2]) + struct.pack(">II", 5, 6)
    own = bytes([0x40, 2, len(path)]) + path + bytes([0x40, 3, 4, 192, 0, 2, 1])
    message = b"\xff" * 16 + b"\0\0\x02" + struct.pack(">H", 4) + bytes([24, 8, 8, 8]) + struct.pack(">H", len(own)) + own + bytes([22, 197, 155, 64])
    update = struct.pack(">IIHH", 174, 1, 0, 1) + bytes([196, 60, 1, 5, 10, 0, 0, 1]) + message
    peers = bytes(4) + struct.pack(">H", 0) + struct.pack(">H", 1) + bytes([2]) + bytes(4) + bytes([196, 60, 1, 5]) + struct.pack(">I", 174)
    rib = bytes(4) + bytes([12, 102, 64]) + struct.pack(">H", 1) + struct.pack(">HIH", 0, 0, len(own)) + own
    data = mrt_record(16, 4, update) + mrt_record(13, 1, peers) + mrt_record(13, 2, rib) + mrt_record(16, 4, b"junk")
    (tmp_path / "updates.gz").write_bytes(gzip.compress(data))
    spark.dataSource.register(mrt.MrtSource)
    rows = readers.normalise(spark.read.format("mrt").option("collector", "rrc19").load(str(tmp_path / "updates.gz")))
    got = sorted((r["elem_type"], r["prefix"], r["peer_asn"], r["origin_asn"], r["has_as_set"]) for r in rows.collect())
    assert got == [("A", "197.155.64.0/22", 174, 6, True), ("R", "102.64.0.0/12", 174, 6, True), ("W", "8.8.8.0/24", 174, None, False)]


ROW = "ts timestamp_ntz, collector string, peer_asn bigint, peer_ip string, elem_type string, prefix string, prefix_ip_version int, prefix_len int, origin_asn bigint, as_path_dedup array<bigint>, as_path_len int"


def elements(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(datetime(2024, 1, d), c, 64, "10.0.0.1", k, p, 4, 8, o, [64, o], 2) for d, c, k, p, o in rows], ROW)


def test_last_of_a_batch_counts(spark):
    batch = elements(spark, [(1, "c", "A", "10.0.0.0/8", o) for o in range(50)]).coalesce(1)
    assert [r["origin_asn"] for r in tables.merge_window(None, batch).collect()] == [49]
    assert [r["origin_asn"] for r in tables.merge_window(batch, batch.where("origin_asn < 7")).collect()] == [6]


def test_partitions_are_listed_compacted_and_dropped(spark, tmp_path):
    path = str(tmp_path / "elements")
    rows = [(d, c, "A", f"{k}.0.0.0/8", k) for d in (1, 2) for c in ("c0", "c1") for k in range(1, 9)]
    tables.write_elements(elements(spark, rows), path, max_rows=3)
    before = {tuple(r)[:3]: r["files"] for r in tables.partitions(spark, path).collect()}
    assert len(before) == 4 and all(n > 1 for n in before.values())
    assert tables.compact(spark, path) == 4 and tables.compact(spark, path) == 0
    after = tables.partitions(spark, path).collect()
    assert all(r["files"] == 1 and r["rows"] == 8 for r in after)
    assert tables.drop_partitions(spark, path, [("2024-01-01", "c0"), ("2024-01-09", "c0")]) == 1
    assert tables.partitions(spark, path).count() == 3
    held = catalog.Catalog(spark, str(tmp_path / "catalog"))
    held.record_partition("elements", "2024-01-02", "c0", path, 1, 10)
    held.record_partition("elements", "2024-01-02", "c0", path, 8, 90)
    assert [(r["name"], r["rows"]) for r in held.registered().collect()] == [("elements/2024-01-02/c0", 8)]


def test_curation_splits_messages_and_snapshots(spark, tmp_path):
    parsed = elements(spark, [(1, "c0", "A", "10.0.0.0/8", 7), (1, "c0", "R", "10.0.0.0/8", 7), (1, "c9", "A", "11.0.0.0/8", 8)])
    tables.curate(spark, parsed, str(tmp_path / "e"), str(tmp_path / "rib"), collectors=["c0"])
    assert spark.read.parquet(str(tmp_path / "e")).select("prefix", "elem_type").collect() == [("10.0.0.0/8", "A")]
    assert spark.read.parquet(str(tmp_path / "rib")).count() == 1


def test_a_failing_read_is_not_a_missing_table(spark, tmp_path):
    with pytest.raises(tables.DataUnavailable):
        tables.read_partitions(spark, str(tmp_path / "none"))
    broken = tmp_path / "broken" / "date=2024-01-01" / "collector=c"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception) as error:
        live._merge_batch(str(tmp_path / "broken"))(elements(spark, [(1, "c", "A", "10.0.0.0/8", 7)]), 0)
    assert not isinstance(error.value, tables.DataUnavailable) and (broken / "part-0.parquet").read_bytes() == b"no parquet at all"


def test_watching_detects_on_the_touched_days(spark, tmp_path):
    seen = []
    merge = live._merge_batch(str(tmp_path / "e"), seen.append)
    merge(elements(spark, [(1, "c", "A", "10.0.0.0/8", 7), (2, "c", "A", "10.0.0.0/8", 7)]), 0)
    merge(elements(spark, [(2, "c", "A", "10.0.0.0/8", 9)]), 1)
    assert [sorted(x) for x in seen] == [["2024-01-01", "2024-01-02"], ["2024-01-02"]]
    got = {r["date"]: r["origin_asn"] for r in spark.read.parquet(str(tmp_path / "e")).withColumn("date", F.col("date").cast("string")).collect()}
    assert got == {"2024-01-01": 7, "2024-01-02": 9}
