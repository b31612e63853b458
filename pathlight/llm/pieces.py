"""SentencePiece encoding and decoding over a relational lattice.

A text becomes units that no piece can cross (a run of word marks with the word after it, or one line
feed). Blocks of texts number their distinct units; the units' bounded-length substrings are exploded
and equi-joined to the piece table, the edges found are grouped by unit, and a higher-order aggregate
folds them into the unit's segmentation. The blocks' numbered texts then meet their units' pieces.

The public vocabulary is a BPE model, for which the best path by summed scores is not what the library
returns. Its fold therefore takes the edges from the best score to the worst, from left to right, and
applies an edge that joins exactly two present segments. ``fold_is_exact`` proves for a vocabulary that
no piece needs a part of worse score, so that this one pass is the library's segmentation. For unigram
vocabularies ``viterbi_segments`` folds the best path over the same lattice.

Units over 60 characters (segments are bits of a long) and units with nine or more spaces in a row
(pieces of equal score) are encoded by the library inside the task.

A unit is folded once for the blocks of ``TOGETHER`` input partitions, so that the places of a frequent unit
are a bounded list however large the corpus is.

The documents are read twice, by block both times, in the same order: those that come out of a shuffle are
materialised first.

Cases: null and empty texts have no pieces; unknown characters become byte pieces; rows may repeat and
ids may be null; an empty table gives an empty result; extra columns are ignored or, where the row is
asked for, kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .lineage import in_fixed_order

MARK = "▁"
_MARK_BYTES = MARK.encode()
LONGEST = 60
_SPACES = " " * 9
#: Bytes of text that number their units together.
BLOCK_BYTES = 40 << 20
#: Input partitions whose units are folded together.
TOGETHER = 64
#: Partitions of units for one of ``spark.sql.shuffle.partitions``: a unit has ten edges and more, which are sorted.
FINER = 2
#: Ids that are handed on together.
_HANDED = 1 << 20


@lru_cache(maxsize=4)
def _processor(proto: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=proto)


class Vocabulary:
    """The tables of a model: pieces, their ranks by score, characters and bytes."""

    def __init__(self, proto: bytes) -> None:
        self.proto = proto
        model = _processor(proto)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        byte = [model.is_byte(i) for i in range(size)]
        plain = [not (byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)]
        self.text = [bytes([int(p[3:5], 16)]) if byte[i] else p.encode() if plain[i] else b"" for i, p in enumerate(pieces)]
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(size):
            if byte[i]:
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.char_ids = np.full(0x110000, -1, np.int32)
        self.edges = {}  # piece of two characters and more -> (score, id)
        for i, p in enumerate(pieces):
            if plain[i] and len(p) == 1:
                self.char_ids[ord(p)] = i
            elif plain[i]:
                self.edges[p.replace(MARK, " ")] = (model.get_score(i), i)
        self.char_ids[ord(" ")] = self.char_ids[ord(MARK)]  # units are written with spaces
        self.longest = max(map(len, self.edges), default=1)

    def edge_rows(self) -> list[tuple[str, int, int]]:
        """(piece, rank, id); equal scores have equal ranks; the empty piece has rank 0."""
        rank = {s: k + 1 for k, s in enumerate(sorted({s for s, _ in self.edges.values()}, reverse=True))}
        return [("", 0, 0), *((p, rank[s], i) for p, (s, i) in self.edges.items())]


def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def fold_is_exact(vocabulary: Vocabulary) -> bool:
    """Whether merging a piece alone, best score first, never needs a part of worse score than itself."""
    scores = {p: s for p, (s, _) in vocabulary.edges.items()}
    for piece, score in scores.items():
        if set(piece) == {" "}:
            continue
        parts = list(piece)
        while len(parts) > 1:
            found = [(-scores[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]
            if not found or -min(found)[0] < score:
                return False
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return True


def _units(column: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.DictionaryArray, np.ndarray]]:
    """Yield (first row, bytes of each text, its units numbered by appearance, bounds of the texts' units).

    Marks are written as spaces; a literal mark is a space to the model as well.
    """
    for row, data, offsets in W.text_blocks(column, 2 << 20):
        if _MARK_BYTES in data.tobytes():
            texts = [data[x:y].tobytes().replace(_MARK_BYTES, b" ") for x, y in zip(offsets[:-1], offsets[1:])]
            sizes = np.diff(offsets)
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        else:
            sizes = np.diff(offsets)
        # A text that isn't empty begins with a mark.
        some = np.flatnonzero(np.diff(offsets) > 0)
        flat = np.insert(data, offsets[some], 0x20)
        begin = offsets[some] + np.arange(len(some))
        space, feed = flat == 0x20, flat == 0x0A
        start = feed.copy()
        start[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
        start[begin] = True
        at = np.flatnonzero(start)
        units = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.concatenate((at, [len(flat)])).astype(np.int64)), pa.py_buffer(flat))
        # Units before each text: texts end where the next one that isn't empty begins.
        ends = np.concatenate((begin[1:], [len(flat)])) if len(some) else begin
        bounds = np.zeros(len(offsets), np.int64)
        bounds[some + 1] = np.searchsorted(at, ends, "left")
        yield row, sizes, units.dictionary_encode(), np.maximum.accumulate(bounds)


def _numbered(batches, block_bytes: int, want_rows: bool):
    """Yield (block id, distinct units, frequent ones first) or (block id, [(rows, bytes of each, numbers, bounds)])."""
    parts: list = []
    rows, digest, size = [], xxhash.xxh3_64(), 0

    def flush():
        both = pa.chunked_array(parts).unify_dictionaries() if len(parts) > 1 else pa.chunked_array(parts)
        names = both.chunk(0).dictionary
        numbers = [c.indices.to_numpy(zero_copy_only=False) for c in both.chunks]
        counts = np.bincount(np.concatenate(numbers), minlength=len(names))
        order = np.argsort(-counts, kind="stable")
        block = np.uint64(digest.intdigest()).astype(np.int64)
        if not want_rows:
            return block, names.take(pa.array(order))
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        return block, [(r, n, place[x], bounds) for (r, n, bounds), x in zip(rows, numbers)]

    for batch in batches:
        texts = batch.column("text")
        for row, sizes, units, bounds in _units(texts):
            parts.append(units)
            rows.append((batch.column("row").slice(row, len(sizes)) if want_rows else None, sizes, bounds))
            digest.update(units.indices.buffers()[1])
            digest.update(units.dictionary.buffers()[2] or b"")
            digest.update(bounds.tobytes())
            size += int(sizes.sum())
            if size >= block_bytes:
                yield flush()
                parts, rows, size, digest = [], [], 0, xxhash.xxh3_64()
    if rows:
        yield flush()


def _pack(numbers: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers in one to four bytes of seven bits each (frequent units have small numbers), compressed."""
    x = numbers.astype(np.uint32)
    size = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21)
    place = np.arange(4)
    parts = (x[:, None] >> (7 * place).astype(np.uint32)) & 127 | (place < size[:, None] - 1).astype(np.uint32) << 7
    return zstandard.ZstdCompressor(level=3).compress(parts.astype(np.uint8)[place < size[:, None]].tobytes())


def _unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    ends = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    out = np.zeros(len(ends), np.uint32)
    for k in range(4):
        more = first + k <= ends
        out[more] |= (raw[first[more] + k] & 127).astype(np.uint32) << np.uint32(7 * k)
    return out


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.cast("int"))


def merge_segments(edges: Column, length: Column) -> Column:
    """The edges (rank << 16 | start << 8 | length) that remain as segments once all merges are done.

    ``edges``: array<struct<edge, need, inner>>, the latter two being masks of the bounds that an edge
    needs and of those inside it.
    """

    def step(mask: Column, e: Column) -> Column:
        applies = (mask.bitwiseAND(e["need"]) == e["need"]) & (F.bit_count(mask.bitwiseAND(e["inner"])) == 1)
        return F.when(applies, mask.bitwiseAND(F.bitwise_not(e["inner"]))).otherwise(mask)

    bounds = F.aggregate(F.sort_array(edges), _bit(length + 1) - 1, step)
    # One element each, so that the fold is made once.
    held = F.array(F.struct(edges.alias("edges"), bounds.alias("bounds")))
    stays = lambda e, b: (b.bitwiseAND(e["need"]) == e["need"]) & (b.bitwiseAND(e["inner"]) == 0)
    return F.flatten(F.transform(held, lambda h: F.transform(F.filter(h["edges"], lambda e: stays(e, h["bounds"])), lambda e: e["edge"])))


def viterbi_segments(edges: Column, length: Column) -> Column:
    """Best path of a unigram lattice: (score, path) with edges array<struct<end, start, score, id>>.

    Every character must be an edge. Equal scores prefer the edge that starts first.
    """
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("path")))

    def step(best: Column, end: Column) -> Column:
        arriving = F.filter(edges, lambda e: e["end"] == end)
        ways = F.transform(
            arriving,
            lambda e: F.struct(
                (F.element_at(best, e["start"].cast("int") + 1)["score"] + e["score"]).alias("score"),
                (-e["start"]).alias("first"),
                F.concat(F.element_at(best, e["start"].cast("int") + 1)["path"], F.array(e["id"].cast("int"))).alias("path"),
            ),
        )
        top = F.array_max(ways)
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), top["path"].alias("path"))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), length.cast("int")), start, step), -1)


def _unit_rows(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(together, block, number, unit): the distinct units of each block."""

    @W.released
    def run(batches):
        together = TaskContext.get().partitionId() // TOGETHER
        for block, names in _numbered(batches, block_bytes, False):
            order = pc.sort_indices(names)  # neighbours share their beginnings: fewer bytes shuffled
            for at in range(0, len(order), _HANDED // 8):
                part = order.slice(at, _HANDED // 8)
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, together, np.int32)), pa.array(np.full(n, block)), part.cast(pa.int32()), names.take(part).cast(pa.string())],
                    names=["together", "block", "number", "unit"],
                )
            names = order = part = None  # before the next block is built
            W.release()

    return docs.select("text").mapInArrow(run, "together int, block bigint, number int, unit string")


def _text_rows(docs: DataFrame, block_bytes: int) -> DataFrame:
    @W.released
    def run(batches):
        for block, parts in _numbered(batches, block_bytes, True):
            for ids, sizes, numbers, bounds in parts:
                packed = [_pack_numbers(numbers[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), block)), ids, pa.array(sizes.astype(np.int64)), pa.array(packed, pa.binary())], names=["block", "row", "n_bytes", "numbers"])
            del parts
            W.release()

    kind = docs.schema["row"].dataType.simpleString()
    return docs.mapInArrow(run, f"block bigint, row {kind}, n_bytes bigint, numbers binary")


def lattice(unit_rows: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, places, edges): the packed edges of every distinct unit, by an equi-join of substrings to pieces.

    ``places`` has the (block, number) of the unit in the blocks that are folded together. Units are dealt by
    one shuffle; grouping them, and grouping their edges, needs no other.
    """
    partitions = FINER * int(unit_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = unit_rows.repartition(partitions, "together", "unit").groupBy("together", "unit").agg(F.collect_list(F.struct("block", "number")).alias("places"))
    n = F.length("unit")
    short = (n >= 2) & (n <= LONGEST) & ~F.contains(F.col("unit"), F.lit(_SPACES))
    # The substring at -1 is empty and stands for the unit itself; it alone carries the places.
    starts = F.when(short, F.sequence(F.lit(-1), n - 2)).otherwise(F.array(F.lit(-1)))
    each = dealt.select("together", "unit", "places", F.explode(starts).alias("start"))
    each = each.select("together", "unit", F.when(F.col("start") < 0, F.col("places")).alias("places"), "start")
    sizes = F.when(F.col("start") < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(2), F.least(F.lit(longest), n - F.col("start"))))
    each = each.select("together", "unit", "places", "start", F.explode(sizes).alias("size"))
    each = each.withColumn("piece", F.substring(F.col("unit"), F.col("start") + 1, F.col("size")))
    found = each.join(F.broadcast(pieces), "piece")
    start, end = F.greatest("start", F.lit(0)), F.greatest("start", F.lit(0)) + F.col("size")
    edge = F.struct(
        (F.shiftleft(F.col("rank").cast("bigint"), 16) + start * 256 + F.col("size")).alias("edge"), _bit(start).bitwiseOR(_bit(end)).alias("need"), (_bit(end) - _bit(start + 1)).alias("inner")
    )
    found = found.select("together", "unit", "places", F.when(F.col("size") > 0, edge).alias("edge"))
    return found.groupBy("together", "unit").agg(F.first("places", ignorenulls=True).alias("places"), F.collect_list("edge").alias("edges"))


class _Finish:
    """Turns the segments of units into ids."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        rows = vocabulary.edge_rows()
        self.by_rank: dict[int, int] = {}
        self.marks = {}
        for piece, rank, i in rows:
            if set(piece) == {" "}:
                self.marks[len(piece)] = i  # pieces of equal score are told apart by length
            else:
                self.by_rank[rank] = i
        self.ids = np.zeros(max(self.by_rank, default=0) + 2, np.int32)
        for rank, i in self.by_rank.items():
            self.ids[rank] = i
        self.mark_rank = next((rank for piece, rank, _ in rows if piece and set(piece) == {" "}), -1)

    def library(self, unit: str) -> list[int]:
        model = _processor(self.v.proto)
        if unit[0] == " ":
            return model.encode(unit[1:])
        return model.encode("\n" + unit)[2:]

    def block(self, names: list[str], segments: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after the other, offsets of the units)."""
        data = "".join(names).encode("utf-32-le", "surrogatepass")
        code = np.frombuffer(data, "<u4")
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        first = np.cumsum(lengths) - lengths
        ids = self.v.char_ids[code]
        flat = segments.flatten().to_numpy(zero_copy_only=False)
        of_unit = np.repeat(np.arange(len(names)), segments.value_lengths().to_numpy(zero_copy_only=False))
        rank, start, size = flat >> 16, flat >> 8 & 255, flat & 255
        at = first[of_unit] + start
        ids[at] = np.where(rank == self.mark_rank, np.array([self.marks.get(int(k), -1) for k in range(256)], np.int32)[size], self.ids[np.where(rank == self.mark_rank, 0, rank)])
        inside = np.zeros(len(code) + 1, np.int64)
        np.add.at(inside, at + 1, 1)
        np.add.at(inside, at + size, -1)
        keep = np.cumsum(inside[:-1]) == 0
        count = np.where(keep, 1, 0)
        other = {}
        for k in np.flatnonzero(keep & (ids < 0)).tolist():
            other[k] = self.v.byte_ids[list(chr(code[k]).encode("utf-8", "replace"))]
            count[k] = len(other[k])
        for k in np.flatnonzero((lengths > LONGEST) | np.fromiter((_SPACES in u for u in names), bool, len(names))).tolist():
            a, b = first[k], first[k] + lengths[k]
            count[a:b] = 0
            for j in range(a, b):
                other.pop(j, None)
            whole = np.array(self.library(names[k]), np.int32)
            other[int(a)], count[a] = whole, len(whole)
        place = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        plain = count == 1
        out[place[plain]] = ids[plain]
        for k, values in other.items():
            out[place[k] : place[k] + len(values)] = values
        ends = np.concatenate((place, [len(out)]))
        return out, ends[np.concatenate((first, [len(code)]))]


def _texts_ids(numbers: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    size = np.diff(offsets)[numbers]
    return ids[np.repeat(offsets[numbers] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def decode(vocabulary: Vocabulary, ids) -> str:
    """The text of piece ids: bytes of byte pieces, marks as spaces, the leading space dropped."""
    ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
    text = b"".join(map(vocabulary.text.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model_path: str, keep_row: bool = False, block_bytes: int = BLOCK_BYTES, digest: bool = False) -> DataFrame:
    """Return (row, n_bytes, ids array<int>); ``row`` is the doc_id or, with ``keep_row``, the whole document.

    With ``digest`` the ids are decoded again and ``decoded_sha256`` tells the text that comes out.
    """
    held = docs.sparkSession.sparkContext.broadcast(load(model_path).proto)

    def shape(rows: list[np.ndarray]) -> dict:
        made = {"ids": _lists(rows)}
        if digest:
            vocabulary = _finish(held.value).v
            made["decoded_sha256"] = pa.array([hashlib.sha256(decode(vocabulary, x).encode()).hexdigest() for x in rows], pa.string())
        return made

    return _encode(docs, model_path, keep_row, block_bytes, "ids array<int>" + ", decoded_sha256 string" * digest, shape)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def _encode(docs: DataFrame, model_path: str, keep_row: bool, block_bytes: int, columns: str, shape: Callable) -> DataFrame:
    """(row, n_bytes, columns): what ``shape`` makes of the id arrays of consecutive documents."""
    spark = docs.sparkSession
    vocabulary = load(model_path)
    if not fold_is_exact(vocabulary):
        raise ValueError("a piece of this vocabulary needs a part of worse score")
    kept = [c for c in docs.columns if c != "text"]
    docs = in_fixed_order(docs).select("text", (F.struct(*[F.col(f"`{c}`") for c in kept]) if keep_row else F.col("doc_id")).alias("row"))
    pieces = spark.createDataFrame([r[:2] for r in vocabulary.edge_rows()], "piece string, rank int")
    edges = lattice(_unit_rows(docs, block_bytes), pieces, vocabulary.longest)
    segments = edges.select("places", "unit", merge_segments(F.col("edges"), F.length("unit")).alias("segments"))
    segments = segments.select(F.explode("places").alias("place"), "unit", "segments")
    proto = spark.sparkContext.broadcast(vocabulary.proto)

    @W.released
    def pack_answers(batches):
        tool = None
        for batch in batches:
            tool = tool or _finish(proto.value)
            ids, offsets = tool.block(batch.column("unit").to_pylist(), batch.column("segments"))
            block, number = batch.column("block").to_numpy(), batch.column("number").to_numpy()
            order = np.lexsort((number, block))
            cut = np.concatenate((np.flatnonzero(np.diff(block[order], prepend=block[order[0]] - 1)), [len(order)])) if len(order) else [0]
            size = np.diff(offsets)
            rows = []
            for a, b in zip(cut[:-1], cut[1:]):
                own = order[a:b]
                rows.append((block[own[0]], _pack(np.diff(number[own], prepend=0)), _pack(size[own]), _pack(_texts_ids(own, ids, offsets))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["block", "numbers", "sizes", "ids"]
            )

    answers = segments.select("place.block", "place.number", "unit", "segments").mapInArrow(pack_answers, "block bigint, numbers binary, sizes binary, ids binary")

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        numbers = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_unpack(x.as_py()).astype(np.int64)) for x in found.column("numbers"))])
        sizes, flat = (np.concatenate([np.zeros(0, np.int32), *(_unpack(x.as_py()).astype(np.int32) for x in found.column(c))]) for c in ("sizes", "ids"))
        n = int(numbers.max()) + 1 if len(numbers) else 0
        first, length = np.full(n, -1, np.int64), np.zeros(n, np.int32)
        first[numbers] = np.cumsum(sizes, dtype=np.int64) - sizes
        length[numbers] = sizes
        del numbers, sizes
        made: dict[str, list] = {}
        rows: list[np.ndarray] = []

        def hand_on() -> None:
            for c, values in shape(rows).items():
                made.setdefault(c, []).append(values)
            rows.clear()

        held = 0
        for packed in texts.column("numbers"):
            x = _unpack_numbers(packed.as_py())
            if len(x) and (int(x.max()) >= n or (first[x] < 0).any()):
                raise RuntimeError("a block of texts doesn't meet its units: the documents change while they are read")
            size = length[x]
            ends = np.cumsum(size, dtype=np.int64)
            rows.append(flat[np.repeat(first[x] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)])
            held += len(rows[-1])
            if held >= _HANDED:
                hand_on()
                held = 0
        if rows or not made:
            hand_on()
        del first, length, flat
        W.release()
        return pa.table({"row": texts.column("row"), "n_bytes": texts.column("n_bytes"), **{c: pa.chunked_array(v) for c, v in made.items()}})

    texts = _text_rows(docs, block_bytes)
    kind = docs.schema["row"].dataType.simpleString()
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, f"row {kind}, n_bytes bigint, {columns}")


@lru_cache(maxsize=2)
def _finish(proto: bytes) -> _Finish:
    return _Finish(Vocabulary(proto))


def encoding_report(docs: DataFrame, model_path: str) -> DataFrame:
    """Return (doc_id, n_bytes, n_pieces, ids_sha256, n_bytes_decoded): the digest of encoding, and decoding again.

    ``ids_sha256`` is over the ids as little-endian 32-bit integers.
    """
    held = docs.sparkSession.sparkContext.broadcast(load(model_path).proto)

    def shape(rows: list[np.ndarray]) -> dict:
        vocabulary = _finish(held.value).v
        return {
            "n_pieces": pa.array([len(x) for x in rows], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in rows], pa.string()),
            "n_bytes_decoded": pa.array([len(decode(vocabulary, x).encode()) for x in rows], pa.int64()),
        }

    return _encode(docs, model_path, False, BLOCK_BYTES, "n_pieces bigint, ids_sha256 string, n_bytes_decoded bigint", shape).withColumnRenamed("row", "doc_id")


def decode_table(encoded: DataFrame, model_path: str) -> DataFrame:
    """Return ``encoded`` (row, ids) with a column ``text`` decoded from the ids."""
    held = encoded.sparkSession.sparkContext.broadcast(load(model_path).proto)

    @W.released
    def run(batches):
        vocabulary = _finish(held.value).v
        for batch in batches:
            texts = [decode(vocabulary, x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("ids"), pa.array(texts, pa.string())], names=["row", "ids", "text"])

    kind = encoded.schema["row"].dataType.simpleString()
    return encoded.select("row", "ids").mapInArrow(run, f"row {kind}, ids array<int>, text string")
