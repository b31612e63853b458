"""SimHash near-duplicates by a binary trie self-join.

Fingerprints of 64 bits are leaves of a binary trie. The self-join walks pairs of trie nodes of equal
depth together, adds up the bits in which their paths differ, and drops a pair as soon as more than
``budget`` bits differ. Two fingerprints within three bits agree in at least one of four blocks of 16
bits; so there are four tries, each with another block first, and a pair of leaves meets below one node
of depth 16 in one of them. These nodes are what Spark distributes: one row per distinct fingerprint
and trie. Inside a node a task keeps only a spanning forest of the links found, so that a large group
of near copies sends on as many rows as it has fingerprints and never all of its pairs.

Cases: null and empty texts, and texts without words, have the fingerprint zero and link like any
other; a text of one or two words has one shingle; exact copies share a fingerprint; rows with a null
doc_id take part, but never name a component (it is null where no member has an id); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .components import connected_components, with_least
from .lineage import cut

SHINGLE = 3
BUDGET = 3
SEED = 42
#: Pairs of nodes walked together.
_FRONTIER = 1 << 18


def _fingerprints(column: pa.Array, shingle: int) -> np.ndarray:
    found = [np.zeros(0, np.uint64)]
    digest = xxhash.xxh64_intdigest
    for _, data, offsets in W.text_blocks(column, 1 << 20):
        data = W.LOWER[data]
        starts, ends, text_of = W.split(data, offsets, W.SPACES)
        out = np.zeros(len(offsets) - 1, np.uint64)
        found.append(out)
        if not len(starts):
            continue
        # Words joined by one space: each word's bytes and the separator after it.
        gap = W.SPACES[data]
        keep = ~gap
        after = ends[ends < len(data)]
        keep[after[gap[after]]] = True
        place = np.cumsum(keep) - keep
        flat = data[keep]
        flat[gap[keep]] = 0x20
        raw = flat.tobytes()
        first = np.searchsorted(text_of, np.arange(len(offsets)), "left")
        n_words = np.diff(first)
        n_shingles = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
        begin = np.repeat(first[:-1] - np.cumsum(n_shingles) + n_shingles, n_shingles) + np.arange(n_shingles.sum())
        final = begin + np.repeat(np.minimum(n_words, shingle), n_shingles) - 1
        low, high = place[starts[begin]].tolist(), (place[ends[final] - 1] + 1).tolist()
        h = np.fromiter((digest(raw[i:j], SEED) for i, j in zip(low, high)), np.uint64, len(low))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = np.flatnonzero(n_shingles)
        sums = np.add.reduceat(bits, (np.cumsum(n_shingles) - n_shingles)[some], axis=0, dtype=np.int32)
        over = 2 * sums > n_shingles[some, None]
        out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return np.concatenate(found)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Return (doc_id, fp bigint), the fingerprint of every document."""

    @W.released
    def run(batches):
        for batch in batches:
            fp = _fingerprints(batch.column("text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


class Linked:
    """Which leaves are connected so far: a label for each, and where it changes from leaf to leaf."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.kept: list[np.ndarray] = []
        self._count()

    def _count(self) -> None:
        self.changes = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1]))) if len(self.label) else self.label

    def one(self, a, a1, b, b1) -> np.ndarray:
        """Whether all leaves of both ranges are connected."""
        c = self.changes
        return (self.label[a] == self.label[b]) & (c[a1 - 1] == c[a]) & (c[b1 - 1] == c[b])

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Connect pairs; those that connect something new are kept."""
        p, q = np.minimum(self.label[x], self.label[y]), np.maximum(self.label[x], self.label[y])
        new = np.flatnonzero(p != q)
        if not len(new):
            return
        _, first = np.unique(np.stack((p[new], q[new])), axis=1, return_index=True)
        new = new[first]
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while (j := parent.get(i, i)) != i:
                parent[i] = parent.get(j, j)
                i = j
            return i

        for k, i, j in zip(new.tolist(), p[new].tolist(), q[new].tolist()):
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
                self.kept.append(np.array([x[k], y[k]]))
        moved = np.arange(len(self.label))
        for i in parent:
            moved[i] = root(i)
        self.label = moved[self.label]
        self._count()


def _close_pairs(u: np.ndarray, budget: int, linked: Linked | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield index pairs of leaves within ``budget`` bits; ``u``: sorted distinct, by trie node of depth 16.

    Pairs of nodes are also dropped once all their leaves are ``linked``, so that a run of near copies is
    walked until it is connected and not until all its pairs are seen.
    """
    top = u >> np.uint64(48)
    edges = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1], [True])))
    low, high = edges[:-1], edges[1:]
    big = high - low > 1
    low, high = low[big], high[big]
    stack = [(16, low, high, low, high, np.zeros(len(low), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, a, a1, b, b1, diff = stack.pop()
        if len(a) > _FRONTIER:
            half = len(a) // 2
            stack.append((depth, a[half:], a1[half:], b[half:], b1[half:], diff[half:]))
            a, a1, b, b1, diff = a[:half], a1[:half], b[:half], b1[:half], diff[:half]
            stack.append((depth, a, a1, b, b1, diff))
            continue
        if linked is not None:
            open_ = ~linked.one(a, a1, b, b1)
            a, a1, b, b1, diff = a[open_], a1[open_], b[open_], b1[open_], diff[open_]
            if not len(a):
                continue
        same = a == b
        # Pairs of leaves are compared at once; nothing is left to prune below them.
        leaf = ~same & (a1 - a == 1) & (b1 - b == 1)
        if leaf.any():
            x, y = a[leaf], b[leaf]
            near = np.bitwise_count(u[x] ^ u[y]) <= budget
            yield x[near], y[near]
        # Where the rest of the path can't exceed the budget, every leaf of one node is close to the other's.
        rest = 64 - depth
        full = ~leaf & (diff + rest <= budget)
        for i in np.flatnonzero(full).tolist():
            members = np.concatenate((np.arange(a[i], a1[i]), np.arange(b[i], b1[i])))
            yield np.full(len(members), a[i]), members
        go = ~leaf & ~full & ~(same & (a1 - a == 1))
        if not go.any():
            continue
        a, a1, b, b1, diff, same = a[go], a1[go], b[go], b1[go], diff[go], same[go]
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((u >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)))
        count = ones[depth]
        am = a1 - (count[a1] - count[a])
        bm = b1 - (count[b1] - count[b])
        parts = [(a, am, b, bm, diff), (am, a1, bm, b1, diff), (a, am, bm, b1, diff + 1)]
        other = ~same
        parts.append((am[other], a1[other], b[other], bm[other], diff[other] + 1))
        new = [np.concatenate(x) for x in zip(*parts)]
        ok = (new[1] > new[0]) & (new[3] > new[2]) & (new[4] <= budget)
        if ok.any():
            stack.append((depth + 1, *(x[ok] for x in new)))


def _forest(u: np.ndarray, budget: int) -> np.ndarray:
    """Spanning forest of the links among the leaves ``u``, as rows of two indexes."""
    linked = Linked(len(u))
    for x, y in _close_pairs(u, budget, linked):
        linked.add(x, y)
    return np.array(linked.kept, np.int64).reshape(-1, 2)


def close_links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Return (a, b) of distinct fingerprints ``fps`` (fp bigint): links that connect what is close.

    Every pair within ``budget`` bits (3 at most) is connected through the links returned.
    """
    if budget > 3:
        raise ValueError("four blocks find pairs within three bits")
    turned = [F.struct(F.lit(r).alias("trie"), (F.col("fp") if not r else F.shiftleft("fp", 16 * r).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * r))).alias("v")) for r in range(4)]
    leaves = fps.select(F.inline(F.array(*turned)))
    leaves = leaves.repartition("trie", F.shiftrightunsigned("v", 48)).sortWithinPartitions("trie", "v")

    def links(trie: np.ndarray, v: np.ndarray):
        for r in np.unique(trie):
            u = v[trie == r].view(np.uint64)
            u = np.sort(u)
            pairs = u[_forest(u, budget)]
            if r:
                pairs = (pairs >> np.uint64(16 * r)) | (pairs << np.uint64(64 - 16 * r))
            pairs = pairs.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    @W.released
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column("trie").to_numpy(), batch.column("v").to_numpy()))
            size += len(held[-1][0])
            if size < 200_000:
                continue
            trie, v = (np.concatenate(x) for x in zip(*held))
            node = trie.astype(np.uint64) << np.uint64(16) | v.view(np.uint64) >> np.uint64(48)
            whole = np.flatnonzero(node != node[-1])  # rows of nodes that are complete
            end = int(whole[-1]) + 1 if len(whole) else 0
            if end:
                yield from links(trie[:end], v[:end])
            held, size = [(trie[end:], v[end:])], len(v) - end
        if size:
            yield from links(*(np.concatenate(x) for x in zip(*held)))

    return leaves.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """Return (doc_id, fp, component_id): the least doc_id reachable over links, itself included."""
    of_docs = cut(fingerprints(docs, shingle))
    nodes = of_docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(close_links(nodes.select("fp"), budget))
    grouped = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    grouped = with_least(grouped, "label", "least", "component_id").select("fp", "component_id")
    return of_docs.join(grouped, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_report(found: DataFrame) -> DataFrame:
    """The digest columns of ``near_duplicates``' result."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """The documents, with all their columns, that have the least doc_id of their component.

    Rows that repeat a doc_id are the same document, of which one row stays; rows without one stay.
    """
    found = near_duplicates(docs.where("doc_id is not null"), shingle, budget).select("doc_id", "component_id")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    # Both joins deal the same rows by doc_id, which Spark does once.
    known = docs.where("doc_id is not null")
    once = known.join(gone.unionByName(again), "doc_id", "left_anti").select(docs.columns)
    # Of repeated rows with unequal texts, that of the least hash.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = known.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64("text")).alias("_row")).select("_row.*")
    return once.unionByName(one).unionByName(docs.where("doc_id is null"))
