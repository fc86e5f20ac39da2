"""N-gram Jaccard join of whole texts: size-aware, heavy-light.

A text's set holds the distinct hashes of its five-word shingles (lower-cased A-Z). Texts with equal
sets form a class; classes are joined. All shingles stand in one global order: rare before frequent
(frequency measured over all rows by a counter table), then by hash. A set's prefix of length
``n - ceil(0.75 n) + k`` shares at least k shingles with that of every linked set.

* Small sets (up to ``boundary`` shingles) enumerate the pairs (subsets of size 2) of their prefix
  for k = 2; small sets meet where they have a subset in common.
* Large sets, and small ones near enough to the boundary to link to a large one, enter inverted
  lists, one per shingle of their prefix for k = 1. Of a long prefix the first few suffice: the first
  t shingles of a union hold no common one with chance below ``MISS`` (1e-12 per linked pair). Sets
  made mostly of frequent shingles use the plain hash order, the others the rare-first order, those
  between use both, so that linked sets always have an order in common.
* ``boundary`` is the size up to which enumerating costs less than listing and scanning.

Scanning: short lists give all their pairs. Long lists are compared through bottom-k sketches in
two rounds: first each set only with the most central set it resembles, then, when the verified pairs
have been united, with sets of other components. Lists above ``TILE`` sets are dealt out as
pairs of tiles. A sketch discards a pair only when it is far from the threshold (error below 1e-7);
all others are verified on their exact sets. So a group of near copies costs about its size in pairs.
These pairs connect the components; they are not all links.

Hot lists, those that the counters show to be longer than a task should take, are dealt out by their
sets from the start and compared as long ones. ``exact=True`` uses whole prefixes and no sketches.

Links are counted afterwards: each stands inside one component, so all sets of a component are compared
exactly with each other, large components as pairs of tiles. Each pair meets once and gives a count for
its sets, never a row.

Null or empty texts and texts without words have an empty set and link with nothing. Fewer than five
words make one shingle, the whole sequence. Repeated rows and null ids are kept: each row gets its
class's component; a null id is never the smallest. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bits import pieces, reached
from tessera.llm.components import components
from tessera.llm.memory import release, released
from tessera.llm.storage import discard, store
from tessera.llm.words import mix, scans, shingle_sets

SIZE = 5
PERCENT = 75
MISS = 1e-12
#: Counters of the frequency table, as a power of two.
COUNTER_BITS = 24
#: Shingles in about so many texts or more are frequent; the noise of the counters comes on top.
FREQUENT = 32
#: One shingle in so many (by hash) is counted exactly, for the cost of lists.
COUNTED = 4096
#: A pair that must be verified costs as much as so many rows of a list.
VERIFY_COST = 20.0
SKETCH = 512
#: Fewer equal sketch entries than this: the similarity is below the threshold (error 1e-8).
SKETCH_LEAST = 322
#: Lists with more sets than this are compared by sketches; shorter ones pair all their sets.
SHORT_LIST = 6
#: Sets of a list that are compared in one task.
TILE = 2048
#: Sets, and bytes of them, that a tile of a component holds when links are counted.
COUNT_TILE = 2048
COUNT_BYTES = 16 << 20
#: Places that the entries of a hot list are dealt to.
SALTS = 32
#: Columns of an overlap that are multiplied at once.
COLUMNS = 2048
#: Sets with this share of frequent shingles, or more, use the hash order ...
HASH_ORDER_FROM = 0.6
#: ... and those below this one the rare-first order. A set below 0.6 links to none above 0.8.
RARE_ORDER_BELOW = 0.81


def needed(n: int) -> int:
    """The least overlap of a set of n shingles with a set it links to."""
    return -(-PERCENT * n // 100)


def listed(n: int, frequent: int, exact: bool = False) -> int:
    """How many first shingles a set of n, ``frequent`` of them frequent, enters into lists."""
    full = n - needed(n) + 1
    if exact:
        return full
    rare = 1 - frequent / n
    other = (100 / PERCENT - 1) / rare if rare > 0 else 1.0  # the greatest share of rare shingles not in common
    return full if other >= 0.97 else min(full, math.ceil(math.log(MISS) / math.log(other)))


def _ordered(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Rare shingles first; each part by hash."""
    f = frequent[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
    return np.concatenate([s[~f], s[f]]) if f.any() else s


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch(s: np.ndarray) -> bytes:
    return np.sort((mix(s) >> np.uint64(32)).astype(np.uint32))[:SKETCH].tobytes() if len(s) else b""


def _summaries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of kind 0: a document's set size, class and sketch; 1: pieces of the frequency table;
    2: a sample of the shingles themselves, one row for each set that holds it."""
    schema = T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()),
        T.StructField("sketch", T.BinaryType()), T.StructField("piece", T.IntegerType()), T.StructField("payload", T.BinaryType()), T.StructField("token", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None
        counts, since = None, 0

        def rows(kind: int, size: int, **given) -> pa.RecordBatch:
            types = {"id": id_type, "n": pa.int64(), "cls": pa.binary(), "sketch": pa.binary(), "piece": pa.int32(), "payload": pa.binary(), "token": pa.int64()}
            arrays = [pa.array(np.full(size, kind, np.int32))] + [given[k] if isinstance(given.get(k), pa.Array) else pa.array(given[k], t) if k in given else pa.nulls(size, t) for k, t in types.items()]
            return pa.RecordBatch.from_arrays(arrays, names=["kind", *types])

        def flush() -> pa.RecordBatch:
            numbers, payloads = pieces(counts)
            return rows(1, len(numbers), piece=numbers, payload=payloads)

        for batch in batches:
            id_type = batch.column(0).type
            for scan in scans(batch.column(1), lower=True):
                if counts is None:
                    counts = np.zeros(1 << COUNTER_BITS, np.uint16)
                if since + len(scan.rows) > 65_000:  # a counter holds up to 65,535
                    yield flush()
                    counts[:] = 0
                    since = 0
                since += len(scan.rows)
                sizes, classes, sketches, tokens = [], [], [], []
                for _, s in shingle_sets(scan, SIZE):
                    sizes.append(len(s))
                    classes.append(_digest(s))
                    sketches.append(_sketch(s))
                    np.add.at(counts, (s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), np.uint16(1))
                    tokens.append(s[mix(s) % np.uint64(COUNTED) == 0])
                yield rows(0, len(sizes), id=batch.column(0).slice(scan.rows.start, len(sizes)), n=sizes, cls=classes, sketch=sketches)
                token = np.concatenate(tokens).view(np.int64)
                if len(token):
                    yield rows(2, len(token), token=token)
        if since:
            yield flush()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(released(run), schema)


def boundary(mean_live: float) -> int:
    """The largest size for which enumerating pairs of the prefix costs no more than lists.

    ``mean_live``: the share of list entries that stand in a list with another set; each of these
    leads to a pair to verify.
    """
    x = 0
    for n in range(3, 2000):
        p = n - needed(n) + 2
        if p * (p - 1) / 2 > listed(n, 0) * (1 + VERIFY_COST * mean_live):
            break
        x = n
    return x


def _postings(docs: DataFrame, text_col: str, tables, small: int, exact: bool) -> DataFrame:
    """``key``, ``cls``, ``n``, ``hot``: the subsets and list entries of every set, once per task and
    class. ``tables``: which shingles are frequent, and which are hot; a subset is hot if both of its are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, heat = (np.unpackbits(np.frombuffer(x, np.uint8)).view(bool) for x in tables.value)
        is_hot = lambda s: heat[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
        seen: set[bytes] = set()
        low = needed(small + 1)  # smaller sets link to no large one
        for batch in batches:
            for scan in scans(batch.column(0), lower=True):
                keys, hot, owners, counts, sizes = [], [], [], [], []
                for _, s in shingle_sets(scan, SIZE):
                    n = len(s)
                    if n < 3 or (cls := _digest(s)) in seen:  # below 3, linked sets are equal
                        continue
                    seen.add(cls)
                    o = _ordered(s, table)
                    own, warm = [], []
                    if n <= small:
                        p = np.sort(o[: n - needed(n) + 2])
                        i, j = np.triu_indices(len(p), 1)
                        own.append(mix(p[i] * np.uint64(0x9E3779B97F4A7C15) + mix(p[j])))
                        h = is_hot(p)
                        warm.append(h[i] & h[j])
                    if n > small or n >= low:
                        f = int(table[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)].sum())
                        if f >= HASH_ORDER_FROM * n:
                            own.append(s[: listed(n, 0, exact)])
                            warm.append(is_hot(own[-1]))
                        if f < RARE_ORDER_BELOW * n:
                            own.append(o[: listed(n, f, exact)])
                            warm.append(is_hot(own[-1]))
                    k, at = np.unique(np.concatenate(own), return_index=True)
                    keys.append(k)
                    hot.append(np.concatenate(warm)[at])
                    owners.append(cls)
                    counts.append(len(k))
                    sizes.append(n)
                if keys:
                    at = np.repeat(np.arange(len(owners)), counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(owners, pa.binary()).take(pa.array(at)), pa.array(np.array(sizes, np.int64)[at]), pa.array(np.concatenate(hot))], names=["key", "cls", "n", "hot"])

    return docs.select(F.col(text_col)).mapInArrow(released(run), "key long, cls binary, n long, hot boolean")


def _links_possible(a: int, b: int) -> bool:
    return 100 * min(a, b) >= PERCENT * max(a, b)


def _scan_lists(postings: DataFrame) -> DataFrame:
    """``long`` false: pairs (a, b) of short lists; ``long`` true: entries (key, a, n) of long ones.

    Hot lists are long whatever they hold, and dealt out by their sets, so none meets in one task."""
    schema = "long boolean, key long, a binary, b binary, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, head, is_long, last = None, [], False, None

        def short_pairs() -> None:
            for j in range(1, len(head)):
                out.extend((False, None, head[i][0], head[j][0], None) for i in range(j) if _links_possible(head[i][1], head[j][1]))

        def emit() -> pa.RecordBatch:
            names = ["long", "key", "a", "b", "n"]
            types = [pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            keys = batch.column(0).to_numpy()
            shared = np.zeros(len(keys), bool)  # neighbours with the same key, or at a batch's edge
            shared[1:] |= keys[1:] == keys[:-1]
            shared[:-1] |= keys[:-1] == keys[1:]
            shared[[0, -1]] = True
            hot = batch.column(3).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(shared | hot)
            for k, cls, n, h in zip(keys[at].tolist(), batch.column(1).take(pa.array(at)).to_pylist(), batch.column(2).to_numpy()[at].tolist(), hot[at].tolist(), strict=True):
                if k != key:
                    if not is_long:
                        short_pairs()
                    key, head, is_long, last = k, [(cls, n)], h, cls
                    if h:
                        out.append((True, key, cls, None, n))
                    continue
                if cls == last:
                    continue
                last = cls
                if not is_long and len(head) < SHORT_LIST:
                    head.append((cls, n))
                    continue
                if not is_long:
                    is_long = True
                    out.extend((True, key, c, None, m) for c, m in head)
                out.append((True, key, cls, None, n))
            if len(out) > 10_000:
                yield emit()
        if not is_long:
            short_pairs()
        yield emit()

    # the list of a key stands together, but for a hot one, and its sets are ordered by size, then class
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("cls"), F.lit(SALTS))).otherwise(0)
    return postings.repartition("key", salt).sortWithinPartitions("key", "n", "cls").mapInArrow(released(run), schema)


def _alike(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Which pairs of rows of two sketch matrices allow a link. A sketch shorter than ``SKETCH`` holds
    its whole set; two such decide the pair but for one entry that may have met another in 32 bits."""
    pad = np.arange(SKETCH, dtype=np.int64)
    x = np.where(pad < nx[:, None], x, pad + (1 << 33))
    y = np.where(pad < ny[:, None], y, pad + (1 << 34))
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    same = both[:, 1:] == both[:, :-1]
    common = (same & (np.cumsum(~same, axis=1) + 1 <= SKETCH)).sum(axis=1)
    whole = (nx < SKETCH) & (ny < SKETCH)
    every = same.sum(axis=1)
    return np.where(whole, 100 * (every + 1) >= PERCENT * (nx + ny - every - 1), common >= SKETCH_LEAST)


def _matrix(sketches: list[bytes]) -> np.ndarray:
    out = np.zeros((len(sketches), SKETCH), np.int64)
    for i, s in enumerate(sketches):
        v = np.frombuffer(s, np.uint32)
        out[i, : len(v)] = v
    return out


class _List:
    """The sets of one list, or of two tiles of it, for comparison by sketches."""

    def __init__(self, rows: dict[str, list]):
        self.cls, self.tile = rows["cls"], np.array(rows["tile"])
        self.n, self.root = np.array(rows["n"], np.int64), np.array(rows["root"], object)
        self.sketch = _matrix(rows["sketch"])
        real = np.arange(SKETCH) < np.minimum(self.n, SKETCH)[:, None]
        row = np.repeat(np.arange(len(self.n)), real.sum(axis=1))
        _, col, count = np.unique(self.sketch[real], return_inverse=True, return_counts=True)
        kept = count[col] > 1
        self.row, self.col, self.weight = row[kept], col[kept], np.bincount(row, count[col])
        self.bounds = np.searchsorted(self.row, np.arange(len(self.n) + 1))
        order = np.argsort(self.col, kind="stable")
        self.owners, self.starts = self.row[order], np.concatenate([[0], np.cumsum(np.bincount(self.col, minlength=len(count)))])

    def sized(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` (bool) whose size allows a link to set i."""
        j = np.flatnonzero(others & (100 * np.minimum(self.n, self.n[i]) >= PERCENT * np.maximum(self.n, self.n[i])))
        return j[j != i]

    def resembling(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` (bool) whose sketch allows a link to set i."""
        cols = self.col[self.bounds[i] : self.bounds[i + 1]]
        met = np.concatenate([self.owners[self.starts[c] : self.starts[c + 1]] for c in cols.tolist()]) if len(cols) else np.zeros(0, np.int64)
        common = np.bincount(met, minlength=len(self.n))
        small, large = np.minimum(self.n, self.n[i]), np.maximum(self.n, self.n[i])
        # whole sets need their overlap; of others at least SKETCH_LEAST of the union's first are common
        least = np.where(large < SKETCH, -(-PERCENT * (large + small) // (100 + PERCENT)) - 1, np.minimum(SKETCH_LEAST, small))
        j = np.flatnonzero(others & (common >= least) & (100 * small >= PERCENT * large))
        j = j[j != i]
        if len(j):
            k = np.full(len(j), i)
            j = j[_alike(self.sketch[k], self.sketch[j], self.n[k], self.n[j])]
        return j


def _scan_long(members: DataFrame, first: bool, exact: bool = False) -> DataFrame:
    """Pairs of sets of long lists (``key``, ``x``, ``y``: a list's pair of tiles; ``tile``, ``cls``,
    ``n``, ``root``, ``sketch``, ``keys``: the set's long lists). First round: each set with the most
    central one that it resembles. Then: sets of different components, in the first list they share.
    ``exact``: then by their sizes alone, without sketches."""

    def run(table: pa.Table) -> pa.Table:
        rows = {c: table.column(c).to_pylist() for c in ("cls", "n", "root", "sketch", "tile")}
        a, b = [], []
        if len(rows["cls"]) > 1:
            x = _List(rows)
            key, cross = table.column("key")[0].as_py(), table.column("x")[0].as_py() != table.column("y")[0].as_py()
            if first:
                free = np.ones(len(x.n), bool)
                for i in np.argsort(-x.weight / np.minimum(x.n, SKETCH), kind="stable").tolist():
                    if free[i]:
                        free[i] = False
                        j = x.resembling(i, free)
                        free[j] = False
                        a += [x.cls[i]] * len(j)
                        b += [x.cls[k] for k in j.tolist()]
            else:
                keys = [set(k) for k in table.column("keys").to_pylist()]
                number = np.unique(np.array([r.hex() for r in rows["root"]]), return_inverse=True)[1]
                # sets of the largest component are compared from the others' side only
                most = np.bincount(number).argmax()
                later = np.ones(len(x.n), bool)
                for i in np.flatnonzero(number != most).tolist():
                    later[i] = False
                    others = (later | (number == most)) & (number != number[i])
                    if cross:
                        others &= x.tile != x.tile[i]
                    for j in (x.sized if exact else x.resembling)(i, others).tolist():
                        if min(keys[i] & keys[j]) == key:
                            a.append(x.cls[i])
                            b.append(x.cls[j])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return members.groupBy("key", "x", "y").applyInArrow(run, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _members(entries: DataFrame, classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The entries of lists with several components, dealt out by pairs of tiles. Without ``roots``
    each set is a component."""
    found = entries.withColumn("root", F.col("cls"))
    if roots is not None:
        found = entries.join(roots.withColumnRenamed("v", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = found.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high").select("key", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    # a hot key's entries must not meet: each list's row stands SALTS times
    salted = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = found.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["key", "salt"]).drop("salt").withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    own = kept.groupBy("cls").agg(F.collect_list("key").alias("keys")).join(classes.select("cls", "sketch"), "cls")
    dealt = kept.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("key", "cls", "n", "root", "tile", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"))
    return dealt.join(own, "cls")


def _verify(docs: DataFrame, text_col: str, classes: DataFrame, pairs: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of classes that do link; the sets (``cls``, ``shingles``) of these and of others."""
    spark = docs.sparkSession
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                keep = _alike(_matrix(part.column(2).to_pylist()), _matrix(part.column(3).to_pylist()), part.column(4).to_numpy(), part.column(5).to_numpy())
                yield part.select([0, 1]).filter(pa.array(keep))

    likely = pairs if exact else store(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(released(near), "a binary, b binary"), "likely")
    wanted = likely.select(F.col("a").alias("cls")).union(likely.select(F.col("b").alias("cls"))).distinct()
    bits = 22

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            at = [int.from_bytes(c[:4], "little") >> (32 - bits) for c in batch.column(0).to_pylist()]
            counts[at] = 1
        numbers, payloads = pieces(counts)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())], names=["piece", "payload"])

    mask = spark.sparkContext.broadcast(np.packbits(reached(wanted.mapInArrow(released(marks), "piece int, payload binary"), bits, 1)[0]).tobytes())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(mask.value, np.uint8)).view(bool)
        seen: set[bytes] = set()
        for batch in batches:
            for scan in scans(batch.column(0), lower=True):
                classes, found = [], []
                for _, s in shingle_sets(scan, SIZE):
                    cls = _digest(s)
                    if len(s) and wanted[int.from_bytes(cls[:4], "little") >> (32 - bits)] and cls not in seen:
                        seen.add(cls)
                        classes.append(cls)
                        found.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(found, pa.binary())], names=["cls", "shingles"])

    full = store(docs.select(F.col(text_col)).mapInArrow(released(sets), "cls binary, shingles binary").groupBy("cls").agg(F.first("shingles").alias("shingles")), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= PERCENT * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: full.select(F.col("cls").alias(x), F.col("shingles").alias(f"s{x}"))
    links = store(likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(released(compare), "a binary, b binary"), "links")
    if not exact:
        discard(likely)
    return links, full


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` has in common with each of ``right``."""
    out = np.zeros((len(left), len(right)), np.int32)
    col = np.unique(np.concatenate([*left, *right]), return_inverse=True)[1]
    lrow, rrow = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    lcol, rcol = col[: len(lrow)], col[len(lrow) :]
    width = int(col.max()) + 1
    many = np.bincount(lcol, minlength=width) * np.bincount(rcol, minlength=width)
    dense = 100 * many > out.size  # so much in common that multiplying costs less than listing
    place = np.cumsum(dense) - 1
    sides = []
    for row, c, n in ((lrow, lcol, len(left)), (rrow, rcol, len(right))):
        at = np.flatnonzero(dense[c])
        at = at[np.argsort(place[c[at]], kind="stable")]
        sides.append((row[at], place[c[at]], n))
    for k in range(0, int(dense.sum()), COLUMNS):
        block = []
        for row, c, n in sides:
            own = slice(*np.searchsorted(c, [k, k + COLUMNS]))
            x = np.zeros((n, COLUMNS), np.float32)
            x[row[own], c[own] - k] = 1
            block.append(x)
        out += (block[0] @ block[1].T).astype(np.int32)
    rare = ~dense & (many > 0)
    at = np.flatnonzero(rare[rcol])
    at = at[np.argsort(rcol[at], kind="stable")]
    held = np.bincount(rcol[at], minlength=width)
    start = np.cumsum(held) - held
    own = np.flatnonzero(rare[lcol])
    times = held[lcol[own]]
    part = np.cumsum(times) // (1 << 21)
    for k in np.unique(part).tolist():
        i, t = own[slice(*np.searchsorted(part, [k, k + 1]))], times[slice(*np.searchsorted(part, [k, k + 1]))]
        step = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        j = rrow[at[np.repeat(start[lcol[i]], t) + step]]
        np.add.at(out, (np.repeat(lrow[i], t), j), 1)
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray], weight: np.ndarray, back: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the sets of each side, the rows (``weight`` of the right, ``back`` of the left side) that they link to."""
    common = _overlaps(left, right)
    nl, nr = (np.array([len(s) for s in x], np.int64) for x in (left, right))
    to, fro = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    for a in range(0, len(left), 256):
        c = common[a : a + 256].astype(np.int64)
        near = 100 * c >= PERCENT * (nl[a : a + 256, None] + nr - c)
        if same:
            near[np.arange(len(near)), np.arange(a, a + len(near))] = False
        to[a : a + 256] = near @ weight
        fro += back[a : a + 256] @ near
    return to, fro


def _count_links(roots: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``cls``, ``links``: the rows of other classes that each class of a component links to.

    Small components share a task by their hash (``part``), large ones are dealt out by pairs of tiles."""
    found = roots.withColumnRenamed("v", "cls").join(sets, "cls").join(classes.select("cls", "m"), "cls")
    sizes = roots.withColumnRenamed("v", "cls").join(classes.select("cls", "n"), "cls").groupBy("root").agg(F.count("*").alias("size"), (8 * F.sum("n")).alias("bytes"))
    sizes = store(sizes.withColumn("tiles", F.ceil(F.greatest(F.col("size") / COUNT_TILE, F.col("bytes") / COUNT_BYTES)).cast("int")), "sizes")
    parts = max(1, math.ceil((sizes.where("tiles = 1").agg(F.sum("bytes")).first()[0] or 0) / (COUNT_BYTES // 2)))
    dealt = found.join(sizes.select("root", "tiles"), "root").withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("x", F.least("tile", "other")).withColumn("y", F.greatest("tile", "other"))
    part = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("root"), F.lit(parts)).cast("string")).otherwise(F.hex("root"))

    def run(table: pa.Table) -> pa.Table:
        root, cls, m, tile, x, y = (table.column(c).to_numpy() for c in ("root", "cls", "m", "tile", "x", "y"))
        shingles = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("shingles")]
        order = sorted(range(len(root)), key=lambda i: (root[i], tile[i]))
        links = np.zeros(len(root), np.int64)
        start = 0
        for end in range(1, len(order) + 1):
            if end < len(order) and root[order[end]] == root[order[start]]:
                continue
            own = np.array(order[start:end])
            start = end
            same = x[own[0]] == y[own[0]]
            a, b = (own, own) if same else (own[tile[own] == x[own[0]]], own[tile[own] == y[own[0]]])
            if not len(a) or not len(b):
                continue
            to, fro = _linked([shingles[i] for i in a], [shingles[i] for i in b], m[b], m[a], same)
            links[a] += to
            if not same:
                links[b] += fro
        out = pa.table({"cls": pa.array(cls.tolist(), pa.binary()), "links": pa.array(links)})
        release()
        return out

    counted = dealt.select(part.alias("part"), "root", "cls", "m", "shingles", "tile", "x", "y").groupBy("part", "x", "y").applyInArrow(run, "cls binary, links long")
    return counted.groupBy("cls").agg(F.sum("links").alias("links"))


@dataclass
class Joined:
    """``rows``: id, n_shingles, cls, root (the component's class); ``links``: verified pairs (a, b)
    of classes that connect the components, not all that link; ``boundary``: the largest small set;
    ``classes``: cls, n, m (its rows); ``roots``: v, root of the classes with a link; ``sets``: their shingles."""

    rows: DataFrame
    links: DataFrame
    boundary: int
    classes: DataFrame
    roots: DataFrame
    sets: DataFrame


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int | None = None, exact: bool = False) -> Joined:
    """Joins all texts of ``docs``. ``small`` overrides the boundary that the costs give. ``exact`` lists
    whole prefixes and verifies every pair that meets, unless already in one component: no link is
    missed with any chance (but for equal 64-bit hashes), at a much higher cost."""
    spark = docs.sparkSession
    summary = store(_summaries(docs, id_col, text_col), "summary")
    rows = summary.where("kind = 0").select("id", "n", "cls", "sketch")
    classes = store(rows.groupBy("cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("m")), "classes")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(FREQUENT, 4 * math.ceil(total / (1 << COUNTER_BITS)))
    # a list below this, counters' noise included, fits into one task
    heat = max(TILE, 2 * least)
    tables = spark.sparkContext.broadcast([np.packbits(x).tobytes() for x in reached(summary.where("kind = 1").select("piece", "payload"), COUNTER_BITS, least, heat)])
    if small is None:
        held = summary.where("kind = 2").groupBy("token").count().agg(F.sum("count").alias("all"), F.sum(F.when(F.col("count") > 1, F.col("count"))).alias("live")).first()
        small = boundary((held["live"] or 0) / held["all"] if held["all"] else 0.0)

    found = store(_scan_lists(_postings(docs, text_col, tables, small, exact)), "lists")
    entries = found.where("long").select("key", F.col("a").alias("cls"), "n")
    central = _scan_long(_members(entries, classes, None), True)
    pairs = store(found.where("not long").select("a", "b").union(central).distinct(), "pairs")
    links, sets = _verify(docs, text_col, classes, pairs, exact)
    discard(pairs)
    roots = components(links)
    more = store(_scan_long(_members(entries, classes, roots), False, exact), "pairs")
    discard(found)
    if not more.isEmpty():
        further, others = _verify(docs, text_col, classes, more, exact)
        links = store(links.union(further), "links")
        sets = sets.union(others.join(sets.select("cls"), "cls", "left_anti"))
        roots = components(links)
    discard(more)
    rows = rows.join(roots.withColumnRenamed("v", "cls"), "cls", "left").select("id", F.col("n").alias("n_shingles"), "cls", F.coalesce("root", "cls").alias("root"))
    return Joined(rows, links, small, classes.select("cls", "n", "m"), roots, sets)


def _grouped(rows: DataFrame, id_col: str, *more: str) -> DataFrame:
    least = rows.where("n_shingles > 0").groupBy("root").agg(F.min("id").alias("least"))
    return rows.join(least, "root", "left").select(
        F.col("id").alias(id_col), "n_shingles", *more, F.when(F.col("n_shingles") > 0, F.coalesce("least", "id")).otherwise(F.col("id")).alias("component_id")
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int | None = None, exact: bool = False) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``n_links``: the other rows that it links to, equal texts included,
    ``component_id``: the smallest id reachable by links, itself included.

    Texts without words keep their own id and have no links. ``exact`` as in :func:`join`.
    """
    found = join(docs, id_col, text_col, small, exact)
    counts = found.classes.where("n > 0").join(_count_links(found.roots, found.sets, found.classes), "cls", "left")
    counts = counts.select("cls", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = found.rows.join(counts, "cls", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    return _grouped(rows, id_col, "n_links")


def _classed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the class of each row's text as ``__cls``."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_digest(s) for scan in scans(batch.column(place), lower=True) for _, s in shingle_sets(scan, SIZE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], names=[*batch.schema.names, "__cls"])

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField("__cls", T.BinaryType())]))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; texts without words stay.

    Equal rows of the id that stays are reduced to one. A null id is not told from another null id:
    rows without id stay. Where an id repeats with different texts, each text is judged by itself.
    """
    every = _grouped(join(docs, id_col, text_col).rows, id_col, "cls").where(F.col(id_col).isNotNull())
    found = store(every.groupBy(id_col).agg(F.min("component_id").alias("least"), F.max("component_id").alias("most_component"), F.max("n_shingles").alias("most"), F.count("*").alias("times")), "groups")
    stays = F.col("most_component") == F.col(id_col)
    kept = docs.join(found.where(~stays).select(id_col), id_col, "left_anti")
    mixed = found.where(stays & (F.col("least") < F.col(id_col))).select(id_col)
    if not mixed.isEmpty():
        gone = every.where(F.col("component_id") < F.col(id_col)).select(id_col, F.col("cls").alias("__cls")).distinct()
        judged = _classed(kept.join(mixed, id_col, "left_semi").select(*docs.columns), text_col).join(gone, [id_col, "__cls"], "left_anti")
        kept = kept.join(mixed, id_col, "left_anti").select(*docs.columns).union(judged.select(*docs.columns))
    again = found.where((F.col("times") > 1) & stays & (F.col("most") > 0)).select(id_col)
    if not again.isEmpty():
        kept = kept.join(again, id_col, "left_anti").union(kept.join(again, id_col, "left_semi").dropDuplicates([id_col, text_col]))
    return kept.select(*docs.columns)
