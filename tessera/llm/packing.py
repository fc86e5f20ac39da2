"""Best-fit packing of token pieces into sequences of one capacity, by exact-complement hashing.

Only the counts per length (at most ``capacity`` numbers, whatever the input) reach the driver, which
plans whole classes of sequences at once. An index, addressed by sum, holds how many single lengths,
pairs and triples of lengths still available add up to each number; it is kept up to date as lengths
run out. For each length from the longest, the gap that it leaves is looked up there, and a
combination that fills it exactly is consumed as often as its counts allow: singles first, then
pairs, then triples, the most even ones first, since small pieces fill more gaps. What remains is
packed best-fit, longest first. Lengths are taken up in ``BLOCKS`` blocks, and a block's combinations
are kept only if the whole plan, best-fit for the rest included, has no more sequences than before; so
the result is never worse than best-fit decreasing alone. The plan is a list of patterns with
multiplicities; its size depends on the capacity, not on the number of pieces. Pieces are ranked
within their length in hash buckets and take the places the plan gives to that rank, so no length,
however frequent, meets in one task.

Null texts are empty and give the end id alone. Only documents longer than the capacity are cut, into
full pieces; the first may be shorter. Equal rows each get their own place. Extra columns are
ignored; an empty table gives an empty result. Pieces of length 0 or above the capacity are refused.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.memory import released
from tessera.llm.ordering import unused
from tessera.llm.storage import store
from tessera.llm.tokens import BYTE_BPE, MEMORY_CHUNKS, encode

CAPACITY = 1024
END_ID = 2
#: Blocks of lengths whose combinations are kept or dropped together.
BLOCKS = 32

Plan = list[tuple[tuple[int, ...], int]]


class Complements:
    """How many single lengths, ordered pairs and ordered triples of available lengths have each sum."""

    def __init__(self, have: np.ndarray):
        self.have, self.patterns = have.copy(), []
        self.one = (have > 0).astype(np.int64)
        self.pairs = np.convolve(self.one, self.one)[: len(have)]
        self.triples = np.convolve(self.pairs, self.one)[: len(have)]

    def copy(self) -> Complements:
        out = Complements.__new__(Complements)
        out.have, out.one, out.pairs, out.triples = (x.copy() for x in (self.have, self.one, self.pairs, self.triples))
        out.patterns = list(self.patterns)
        return out

    def _gone(self, x: int) -> None:
        """Takes length x out of all sums (by inclusion and exclusion)."""
        n = len(self.have)
        self.triples[x:] -= 3 * self.pairs[: n - x]
        self.triples[2 * x :] += 3 * self.one[: max(0, n - 2 * x)]
        self.triples[3 * x : 3 * x + 1] -= 1
        self.pairs[x:] -= 2 * self.one[: n - x]
        self.pairs[2 * x : 2 * x + 1] += 1
        self.one[x] = 0

    def consume(self, pattern: tuple[int, ...]) -> None:
        """As many sequences of this pattern as the counts allow."""
        lengths, times = np.unique(pattern, return_counts=True)
        k = int((self.have[lengths] // times).min())
        if k:
            self.have[lengths] -= k * times
            self.patterns.append((pattern, k))
            for x in lengths[self.have[lengths] == 0].tolist():
                self._gone(x)

    def two(self, total: int, most: int) -> Iterator[tuple[int, int]]:
        """Available lengths b >= c with b + c = total and b <= most, the most even first."""
        b = np.arange((total + 1) // 2, min(total - 1, most) + 1) if total > 1 and self.pairs[total] else np.zeros(0, np.int64)
        for x in b[(self.have[b] > 0) & (self.have[total - b] > 0)].tolist():
            if self.have[x] and self.have[total - x]:
                yield x, total - x

    def fill(self, a: int, parts: int) -> None:
        """Consumes sequences of length a with ``parts`` others that are not longer and fill its gap."""
        gap = len(self.have) - 1 - a
        if parts == 1:
            if not gap:
                self.consume((a,))
            elif gap <= a and self.one[gap]:
                self.consume((a, gap))
        elif parts == 2:
            for pair in self.two(gap, a):
                self.consume((a, *pair))
                if not self.have[a]:
                    break
        elif self.triples[gap]:
            b = np.arange((gap + 2) // 3, min(a, gap - 2) + 1)
            for x in b[(self.have[b] > 0) & (self.pairs[gap - b] > 0)].tolist():
                for pair in self.two(gap - x, x):
                    if self.have[x]:
                        self.consume((a, x, *pair))
                    if not (self.have[a] and self.have[x]):
                        break
                if not self.have[a]:
                    break


def _sequences(patterns: Plan) -> int:
    return sum(k for _, k in patterns)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Patterns (lengths of one sequence) and how many sequences follow each; uses every piece once."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} does not fit into {capacity}")
        have[length] = n
    index, rest = Complements(have), _best_fit(have, capacity)
    for parts in (1, 2, 3):
        for block in np.array_split(np.arange(capacity, 0, -1), BLOCKS):
            tried = index.copy()
            for a in block.tolist():
                if tried.have[a]:
                    tried.fill(a, parts)
            if len(tried.patterns) > len(index.patterns):
                left = _best_fit(tried.have, capacity)
                if _sequences(tried.patterns) + _sequences(left) <= _sequences(index.patterns) + _sequences(rest):
                    index, rest = tried, left
    return index.patterns + rest


def _best_fit(have: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing over counts: equal pieces and equal sequences move together."""
    full: Plan = []
    gaps: list[int] = []  # sorted gaps of open sequences
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def add(pattern: tuple[int, ...], k: int) -> None:
        gap = capacity - sum(pattern)
        if not k:
            return
        if not gap:
            full.append((pattern, k))
            return
        if not open_[gap]:
            insort(gaps, gap)
        open_[gap].append((pattern, k))

    for length in range(capacity, 0, -1):
        n = int(have[length])
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                add((length,) * each, n // each)
                add((length,) * (n % each), 1 if n % each else 0)
                break
            gap = gaps[at]
            pattern, k = open_[gap].pop()
            if not open_[gap]:
                gaps.pop(at)
            used = min(k, n)
            add(pattern, k - used)
            add((*pattern, length), used)
            n -= used
    return full + [x for gap in gaps for x in open_[gap]]


def places(patterns: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of the runs of places, their first sequence and their offset."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, k in patterns:
        offset = 0
        for length in pattern:
            runs[length].append((used[length], first, offset))
            used[length] += k
            offset += length
        first += k
    return {length: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for length, r in runs.items()}


def pieces(docs: DataFrame, tokenizer: str = BYTE_BPE, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, memory: int = MEMORY_CHUNKS) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``, little-endian unsigned
    32-bit) of every document's tokens with the end id, cut only where longer than ``capacity``."""
    fields = [docs.schema[id_col], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, flat, bounds in encode(batch.column(1), tokenizer, memory):
                at, piece, start, length, crc, raw = [], [], [], [], [], []
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    ids = np.concatenate([flat[a:b], end])
                    cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        at.append(i + k)
                        piece.append(p)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(ids[x:y]))
                        if with_ids:
                            raw.append(ids[x:y].tobytes())
                arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(raw, pa.binary())] * with_ids, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(released(run), schema)


def pack(items: DataFrame, order: list[str], capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``. ``order``: columns that tell items of one length
    apart (rows equal in all of them may swap places). ``items`` must be a stored table."""
    spark = items.sparkSession
    sizes = {r[0]: r[1] for r in items.groupBy(length_col).agg(F.count("*")).toLocalIterator()}
    spots = spark.sparkContext.broadcast(places(plan(sizes, capacity)))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket, before_, rank = (unused(items.columns, x) for x in ("__bucket", "__before", "__rank"))
    own = Window.partitionBy(bucket, length_col).orderBy(*order)
    earlier = Window.partitionBy(length_col).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    dealt = items.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    offsets = dealt.groupBy(bucket, length_col).agg(F.count("*").alias(rank)).select(bucket, length_col, F.coalesce(F.sum(rank).over(earlier), F.lit(0)).alias(before_))
    ranked = dealt.withColumn(rank, F.row_number().over(own).cast("long")).join(offsets, [bucket, length_col]).select(*items.columns, (F.col(rank) - 1 + F.col(before_)).alias(rank))
    at = items.columns.index(length_col)
    schema = T.StructType([*items.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                first, base, place = spots.value[x]
                rows = np.flatnonzero(length == x)
                k = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows] = base[k] + rank[rows] - first[k]
                offset[rows] = place[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str = BYTE_BPE, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, memory: int = MEMORY_CHUNKS) -> DataFrame:
    """Tokenizes, cuts and packs ``docs``; one row per piece. ``memory`` as in :func:`tokens.encode`."""
    cut = store(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids, memory), "pieces")
    return pack(cut, [id_col, "piece", "start", "ids_crc32"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids``, ``lengths`` of rows that :func:`pack_documents` gave ``with_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"), F.transform("p", lambda x: x["length"]).alias("lengths"))
