import ipaddress
import uuid

import pytest
from pyspark.sql import functions as F

from pathlight.functions import ids, paths, prefixes, windows


def one(spark, expression, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("text, path, is_set", [("3320 {6939,2914} 37100", [3320, 6939, 2914, 37100], True), ("1.10 65000", [65546, 65000], False), ("", [], False), (None, [], False), ("x 5 y", [5], False)])
def test_parse_path(spark, text, path, is_set):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(paths.parse_path(F.col("t")), paths.has_as_set(F.col("t"))).first()[:] == (path, is_set)


def test_path_parts(spark):
    df = spark.createDataFrame([([174, 3320, 3320, 37100],), ([5],), ([],)], "p array<bigint>")
    got = df.select(paths.drop_prepends(F.col("p")), paths.origin(F.col("p")), paths.upstream(F.col("p")), paths.links(F.col("p"))).collect()
    assert [r[:3] for r in got] == [([174, 3320, 37100], 37100, 3320), ([5], 5, None), ([], None, None)]
    assert [(x["a"], x["b"]) for x in got[0][3]] == [(174, 3320), (3320, 3320), (3320, 37100)] and got[1][3] == got[2][3] == []


def test_orient_stops_at_first_target(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],)], "p array<bigint>")
    both = df.select(paths.orient(F.col("p"), F.array(F.lit(2).cast("bigint"))), paths.orient(F.col("p"), F.array(F.lit(9).cast("bigint")))).first()
    assert both[:] == ([4, 3, 2], [4, 3, 2, 1])


@pytest.mark.parametrize(
    "links, bad",
    [(["up", "peer", "down"], None), (["down", "up"], 1), (["peer", "peer"], 1), (["down", None, "peer"], 2), (["up", None], None), (["up", "up", "down", "down"], None), ([None, None], None)],
)
def test_valley_free(spark, links, bad):
    df = spark.createDataFrame([(links,)], "r array<string>")
    assert df.select(paths.valley_free_violation(F.col("r"))).first()[0] == bad


PREFIXES = ["10.1.2.3/8", "2001:db8::/32", "::/0", "::1", "fe80::1:2/64", "1.2.3.4", "300.1.1.1/8", "1.2.3.4/33", "x", "", None, "2c0f:fb50::/32", "1:2:3:4:5:6:7:8/127", "01.2.3.4/8"]


def test_prefix_keys_agree_with_python(spark):
    df = spark.createDataFrame([(p,) for p in PREFIXES], "prefix string")
    for r in df.select("prefix", prefixes.is_valid(F.col("prefix")).alias("ok"), prefixes.key(F.col("prefix")).alias("key")).collect():
        try:
            net = ipaddress.ip_network(r["prefix"], strict=False)
        except ValueError:
            assert not r["ok"], r
            continue
        assert r["ok"] and r["key"] == format(int(net.network_address), f"0{net.max_prefixlen}b")[: net.prefixlen], r


def test_bogons_and_reserved(spark):
    from pathlight.operators import origin

    df = spark.createDataFrame([("10.1.0.0/16", 5), ("8.8.8.0/24", 64512), ("2001:db8:1::/48", 1), ("junk", 23456), ("8.0.0.0/8", None)], "prefix string, origin_asn bigint")
    got = {r["prefix"]: (r["is_bogon"], r["is_reserved_asn"]) for r in origin.bogons(df).collect()}
    assert got == {"10.1.0.0/16": (True, False), "8.8.8.0/24": (False, True), "2001:db8:1::/48": (True, False), "junk": (True, True), "8.0.0.0/8": (False, False)}


@pytest.mark.parametrize("seen, status", [([0, 1, 2, 3], "stable"), ([1, 2, 3], "new"), ([0], "left"), ([0, 2, 3], "unstable"), ([1], "unstable"), ([], "unstable")])
def test_presence(spark, seen, status):
    df = spark.createDataFrame([(seen, [0, 1, 2, 3])], "s array<int>, d array<int>")
    assert df.select(windows.presence(F.col("s"), F.col("d"))).first()[0] == status


def test_presence_without_days_is_stable(spark):
    df = spark.createDataFrame([([], [])], "s array<int>, d array<int>")
    assert df.select(windows.presence(F.col("s"), F.col("d"))).first()[0] == "stable"


def test_uuid5(spark):
    df = spark.createDataFrame([("a",), ("é|1",), ("",)], "n string")
    assert all(r[1] == str(uuid.uuid5(uuid.NAMESPACE_URL, r[0])) for r in df.select("n", ids.uuid5(uuid.NAMESPACE_URL, F.col("n"))).collect())


def test_islands_skip_days_without_collection(spark):
    days = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("a", 9)], "k string, day int")
    calendar = spark.createDataFrame([(d,) for d in (1, 2, 5, 7, 9)], "day int")
    got = sorted(windows.islands(days, ["k"], calendar).select("run_start", "run_end", "n_days").collect())
    assert [tuple(r) for r in got] == [(1, 5, 3), (9, 9, 1)]


def test_unknown_window():
    with pytest.raises(ValueError):
        windows.tumbling(None, "7m")


def test_prefixes_agree_with_the_standard_library(spark):
    import ipaddress
    import random

    from pathlight.functions import prefixes

    rng, texts = random.Random(13), []
    for _ in range(300):
        address = ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), rng.getrandbits(32), rng.getrandbits(16) << 112, 0xFFFF00000000 + rng.getrandbits(32), 0x20010DB8 << 96 | rng.getrandbits(20)]))
        quad = str(ipaddress.IPv4Address(int(address) & 0xFFFFFFFF))
        groups = address.exploded.split(":")
        text = rng.choice([str(address), address.exploded, str(address).upper(), ":".join(groups[:6]) + ":" + quad, str(ipaddress.IPv6Address(int(address) >> 32 << 32)).removesuffix("::") + "::" + quad])
        texts.append(text + rng.choice(["", f"/{rng.randrange(0, 131)}", "%eth0", ""]))
        texts.append(str(ipaddress.IPv4Address(rng.getrandbits(32))) + rng.choice(["", f"/{rng.randrange(0, 35)}"]))
    texts += ["::", "::/0", "1::2::3", ":::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "::ffff:1.2.3.256", "::1.2.3", "1.2.3.4::", "fe80::1%", "fe80::1%a%b", "fe80::%1/64", "g::", "12345::", "", "/", ":", "1:", "::/129", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.4/120"]

    def want(text):
        try:
            if "/" in text:
                if "%" in text:
                    return None  # no network has a zone
                return format(int(ipaddress.ip_interface(text).ip), "0128b" if ":" in text else "032b")
            return format(int(ipaddress.ip_address(text)), "0128b" if ":" in text else "032b")
        except ValueError:
            return None

    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "p string")
    got = {r["p"]: (r["ok"], r["b"]) for r in rows.select("p", prefixes.is_valid(F.col("p")).alias("ok"), prefixes.bits(F.col("p")).alias("b")).collect()}
    wrong = {t: (got[t], want(t)) for t in got if got[t] != (want(t) is not None, want(t))}
    assert not wrong, dict(list(wrong.items())[:8])
