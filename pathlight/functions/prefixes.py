"""IP prefixes as text and as bit-string keys; containment becomes an equi-join on (version, length, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathlight.session import merged

# Address space that must not be routed.
BOGONS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "::/8", "100::/64", "2001:db8::/32", "fc00::/7", "fe80::/10", "ff00::/8",
)
# Reserved and private AS number ranges.
RESERVED_ASNS = ((0, 0), (23456, 23456), (64512, 65534), (65535, 65535), (4200000000, 4294967294), (4294967295, 4294967295))


def version(prefix: Column) -> Column:
    return F.when(F.instr(prefix, ":") > 0, 6).otherwise(4)


def length(prefix: Column) -> Column:
    """Length after the slash; the full length without one; null if it isn't a number."""
    own = F.split(prefix, "/")
    return F.when(F.size(own) == 1, F.when(version(prefix) == 6, 128).otherwise(32)).otherwise(F.try_to_number(F.get(own, F.lit(1)), F.lit("999")).cast("int"))


_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(\.{_OCTET}){{3}}"


def _hextets(prefix: Column) -> Column:
    """The IPv6 address of the prefix, an embedded IPv4 address as two groups and without a zone."""
    address = F.substring_index(F.substring_index(prefix, "/", 1), "%", 1)
    pair = lambda a, b: F.concat(*[F.lpad(F.conv(x, 10, 16), 2, "0") for x in (a, b)])
    whole = lambda quad: F.concat(F.regexp_replace(address, rf"(?<=:){_QUAD}$", ""), pair(quad[0], quad[1]), F.lit(":"), pair(quad[2], quad[3]))
    return F.when(address.rlike(rf":{_QUAD}$"), _named(F.split(F.regexp_extract(address, r"[0-9.]+$", 0), r"\."), whole)).otherwise(address)


def _named(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_valid(prefix: Column) -> Column:
    """Whether the text is an address of either version with a possible length; IPv6 with an embedded IPv4 address too.

    An address may have a zone, a network (with a length) not.
    """
    v4 = rf"^{_QUAD}(/([0-9]|[12][0-9]|3[0-2]))?$"
    return F.coalesce(F.when(version(prefix) == 6, _valid_v6(prefix)).otherwise(prefix.rlike(v4)), F.lit(False))


def _valid_v6(prefix: Column) -> Column:
    whole = r"^(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(([0-9a-fA-F]{1,4}:)*[0-9a-fA-F]{1,4})?::(([0-9a-fA-F]{1,4}:)*[0-9a-fA-F]{1,4})?)$"
    size = r"^[^/]*(/([0-9]|[1-9][0-9]|1[01][0-9]|12[0-8]))?$"

    def judged(address: Column) -> Column:
        groups = F.size(F.filter(F.split(address, ":"), lambda x: x != ""))
        return address.rlike(whole) & (groups <= F.when(F.instr(address, "::") > 0, 7).otherwise(8))  # :: is a group at least

    return prefix.rlike(size) & (~prefix.contains("%") | prefix.rlike(r"^[^/%]*%[^/%]+$")) & _named(_hextets(prefix), judged)


def bits(prefix: Column) -> Column:
    """The address as a string of 32 or 128 binary digits; invalid text gives null."""
    return F.when(is_valid(prefix), valid_bits(prefix))


def valid_bits(prefix: Column) -> Column:
    """``bits`` of text that is known to be valid."""
    binary = lambda x, size, base: F.lpad(F.conv(x, base, 2), size, "0")
    v4 = F.array_join(F.transform(F.split(F.substring_index(prefix, "/", 1), r"\."), lambda x: binary(x, 8, 10)), "")
    full = lambda text: F.filter(F.split(text, ":"), lambda x: x != "")

    def v6(address: Column) -> Column:
        left, right = full(F.substring_index(address, "::", 1)), F.when(F.instr(address, "::") > 0, full(F.substring_index(address, "::", -1))).otherwise(F.array().cast("array<string>"))
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
        return F.array_join(F.transform(F.concat(left, zeros, right), lambda x: binary(x, 16, 16)), "")

    return F.when(version(prefix) == 6, _named(_hextets(prefix), v6)).otherwise(v4)


def key(prefix: Column) -> Column:
    """The network bits of the prefix; host bits are masked."""
    return F.substring(bits(prefix), F.lit(1), length(prefix))


def reserved_asn(asn: Column) -> Column:
    out = F.lit(False)
    for low, high in RESERVED_ASNS:
        out = out | asn.between(low, high)
    return F.coalesce(out, F.lit(False))


def with_ancestors(prefixes: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Rows (prefix, version, len, key) for every covering prefix of the distinct ``prefix`` values, itself included.

    ``lengths``: one row (lengths array<struct<version: int, len: int>>) of those worth probing; all without it.
    """
    held = prefixes.select("prefix").distinct().where(is_valid(F.col("prefix")))
    held = held.select("prefix", version(F.col("prefix")).alias("version"), length(F.col("prefix")).alias("own"), valid_bits(F.col("prefix")).alias("all_bits"))
    probes = F.sequence(F.lit(0), F.col("own"))
    if lengths is not None:
        held = held.join(F.broadcast(lengths))  # one row, of 162 entries at most
        probes = F.transform(F.filter("lengths", lambda x: (x["version"] == F.col("version")) & (x["len"] <= F.col("own"))), lambda x: x["len"])
    held = held.select("prefix", "version", "own", "all_bits", F.explode(probes).alias("len"))
    return held.select("prefix", "version", "own", "len", F.substring(F.col("all_bits"), F.lit(1), F.col("len")).alias("key"))


def containment_join(prefixes: DataFrame, reference: DataFrame) -> DataFrame:
    """Inner join of the distinct ``prefix`` values with every reference row whose ``prefix`` covers them.

    Reference columns keep their names but for ``prefix``, which is ``covering``; ``own`` is the length
    of the prefix and ``len`` that of the covering one.
    """
    ref = reference.where(is_valid(F.col("prefix"))).withColumnRenamed("prefix", "covering")
    ref = ref.withColumn("version", version(F.col("covering"))).withColumn("len", length(F.col("covering"))).withColumn("key", F.substring(valid_bits(F.col("covering")), F.lit(1), length(F.col("covering"))))
    lengths = ref.agg(F.collect_set(F.struct("version", "len")).alias("lengths"))
    return with_ancestors(prefixes, lengths).join(merged(ref), ["version", "len", "key"]).drop("key")


def bogon_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in BOGONS], "prefix string")
