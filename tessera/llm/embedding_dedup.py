"""Near-duplicate vectors by sorted projection passes.

Each pass draws ``CODE_BITS`` random hyperplanes and orders the vectors of a label lexicographically by
their signs (the concatenated hashes). Every vector is compared with the ``WINDOW`` ones before it in
that order, across partition edges too: partitions give out their first and last rows, which are
compared with those of the neighbours. Pairs at or above the threshold are links; links of all passes
are united. The number of passes follows from the largest label: two vectors at the threshold that
agree in the first ``log2(largest / WINDOW)`` signs are taken to meet, and in no pass do so with chance
below ``MISS`` (nearer pairs less by far). ``exact=True`` compares all vectors of a label instead.

Passes carry codes and the vectors in 8-bit steps with a bound of their error, not the vectors. A pair
that is a link by that bound is united at once, so a partition gives one row per linked vector and no
pairs, whatever a group's size; a pair within the bound of the threshold is given out and verified on
the vectors, by exact cosine in double precision; the others are none. Links are counted afterwards: each
stands inside one component, so the vectors of a component are fetched once and compared exactly with
each other, components above ``TILE`` vectors as pairs of tiles.

Equal vectors of a label count as one with a multiplicity. Vectors that are null, zero or hold null or
non-finite components, and rows with null label or id, link with nothing: ``n_links`` 0, their own
component. Vectors of different lengths do not link. Repeated rows are vectors of their own. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import components
from tessera.llm.storage import discard, store

THRESHOLD = 0.93
MISS = 1e-6
WINDOW = 1024
#: Signs in a code; they order vectors far beyond what a window needs.
CODE_BITS = 63
#: Rows of a pass in a task, about.
PART_ROWS = 1 << 18
#: Vectors of a component in a task.
TILE = 16384
SEED = 71


def passes_for(largest: int, threshold: float = THRESHOLD) -> int:
    """Passes for so many vectors of one label."""
    bits = max(0, math.ceil(math.log2(max(1, largest) / WINDOW)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if same >= 1 else math.ceil(math.log(MISS) / math.log1p(-same))


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that links between places i and j lead to, for each of n places."""
    root = np.arange(n)
    while len(i):
        low, least = root.copy(), np.minimum(root[i], root[j])
        for at in (i, j, root[i], root[j]):
            np.minimum.at(low, at, least)
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, kind: str) -> DataFrame:
    """``id``, ``label``, ``digest``, ``v``: the vector's bytes; null where it links with nothing."""
    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("label", vectors.schema[label_col].dataType), T.StructField("digest", T.BinaryType()), T.StructField("v", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, raw = [], []
            for label, own, v in zip(batch.column(1), batch.column(0), batch.column(2), strict=True):
                x = None
                if v.is_valid and label.is_valid and own.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # one zero only
                    x = x.astype(kind).tobytes() if np.isfinite(x).all() and x.any() else None
                raw.append(x)
                digests.append(None if x is None else hashlib.blake2b(x, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], names=schema.names)

    return vectors.select(id_col, label_col, vector_col).mapInArrow(run, schema)


def _coded(classes: DataFrame, passes: int, kind: str) -> DataFrame:
    """A row of every vector for every pass: its code, and its components in 8-bit steps with the step
    and a bound of the error."""
    label = classes.schema["label"]
    schema = T.StructType([T.StructField("pass", T.IntegerType()), label, T.StructField("width", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("num", T.LongType()), T.StructField("q", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, width = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                x = _unit([raw[k] for k in at.tolist()], kind)
                step = np.abs(x).max(axis=1, keepdims=True) / 127
                q = np.rint(x / step).astype(np.int8)
                error = np.sqrt(((x - q * step.astype(np.float32)) ** 2).sum(axis=1, keepdims=True)) + 1e-6
                payload = np.concatenate([q.view(np.uint8), np.concatenate([step, error], axis=1).astype("<f4").view(np.uint8)], axis=1)
                offsets = (np.arange(len(at) + 1) * payload.shape[1]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(payload))])
                head = [batch.column(1).take(pa.array(at)), pa.array(np.full(len(at), w, np.int32))]
                own = batch.column(0).take(pa.array(at))
                small = x.astype(np.float32)
                for p in range(passes):
                    planes = np.random.Generator(np.random.PCG64([SEED, x.shape[1], p])).standard_normal((x.shape[1], CODE_BITS + 1), np.float32)
                    code = np.packbits(small @ planes > 0, axis=1).view(">u8").reshape(-1) >> np.uint64(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), *head, pa.array(code.astype(np.int64)), own, packed], names=schema.names)

    return classes.select("num", "label", "v", "width").mapInArrow(run, schema)


def _steps(q: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and error bounds of rows of one width."""
    payload = np.frombuffer(b"".join(q.to_pylist()), np.uint8).reshape(len(q), -1)
    step, error = np.ascontiguousarray(payload[:, width:]).view("<f4").T
    return np.ascontiguousarray(payload[:, :width]).view(np.int8) * step[:, None], error


def _near(x: np.ndarray, ex: np.ndarray, y: np.ndarray, ey: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (of x, of y) that are links or may be, and which of them surely are."""
    if not len(x) or not len(y):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    same = x @ y.T
    i, j = np.nonzero(same >= threshold - (ex.max() + 1.1 * ey.max() + 1e-5))
    gap, bound = same[i, j] - threshold, ex[i] + 1.1 * ey[j] + 1e-5
    kept = gap >= -bound
    return i[kept], j[kept], (gap >= bound)[kept]


def _scanned(coded: DataFrame, parts: int, threshold: float) -> DataFrame:
    """Of the sorted rows: links (kind 0: vector, root), pairs to verify (1), the first and last rows of
    partitions (2, ``side`` 0 and 1, ``at`` counted from the edge), rows of partitions (3, ``at``)."""
    label = coded.schema["label"]
    order = ["pass", "label", "width", "code", "num"]
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("part", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("pass", T.IntegerType()), label, T.StructField("width", T.IntegerType()), T.StructField("q", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        rows, part = pa.Table.from_batches(held).combine_chunks(), TaskContext.get().partitionId()
        names, kinds = schema.names, {}

        def out(kind: int, n: int, **given) -> pa.RecordBatch:
            kinds.update({"kind": pa.int32(), "part": pa.int64(), "side": pa.int32(), "at": pa.int64(), "a": pa.int64(), "b": pa.int64(), "pass": pa.int32(), "label": rows.schema.field("label").type, "width": pa.int32(), "q": pa.binary()})
            given |= {"kind": np.full(n, kind, np.int32), "part": np.full(n, part, np.int64)}
            return pa.RecordBatch.from_arrays([(v if isinstance(v, pa.Array) else pa.array(v, t)) if (v := given.get(k)) is not None else pa.nulls(n, t) for k, t in kinds.items()], names=names)

        column = lambda name: rows.column(name).combine_chunks() if isinstance(rows.column(name), pa.ChunkedArray) else rows.column(name)
        number, width, num, q = column("pass").to_numpy(), column("width").to_numpy(), column("num").to_numpy(), column("q")
        own = column("label").dictionary_encode().indices.to_numpy()
        n = len(num)
        new = np.concatenate([[True], (number[1:] != number[:-1]) | (own[1:] != own[:-1]) | (width[1:] != width[:-1])])
        start = np.flatnonzero(new)
        for s, e in zip(start.tolist(), [*start[1:].tolist(), n], strict=True):
            unit = (len(q[s].as_buffer()) - 8) if e > s else 0
            left, right, sure = [], [], []
            x, error = _steps(q.slice(s, e - s), unit)
            block = max(1, WINDOW // 4)
            for b in range(0, e - s, block):
                lo, hi = max(0, b - WINDOW), min(e - s, b + block)
                i, j, certain = _near(x[b:hi], error[b:hi], x[lo:hi], error[lo:hi], threshold)
                i, j = i + b, j + lo
                kept = j < i
                left.append(i[kept])
                right.append(j[kept])
                sure.append(certain[kept])
            i, j, certain = np.concatenate(left), np.concatenate(right), np.concatenate(sure)
            root = _roots(e - s, i[certain], j[certain])
            at = np.flatnonzero(root != np.arange(e - s))
            if len(at):
                yield out(0, len(at), a=num[s + at], b=num[s + root[at]])
            open_ = ~certain & (root[i] != root[j])
            if open_.any():
                yield out(1, int(open_.sum()), a=num[s + i[open_]], b=num[s + j[open_]])
        yield out(3, 1, at=[n])
        # only rows of the first and of the last run have neighbours beyond the edges
        first, last = min(WINDOW, int(start[1]) if len(start) > 1 else n), min(WINDOW, n - int(start[-1]))
        for side, s, e in ((0, 0, first), (1, n - last, n)):
            place = np.arange(e - s) if side == 0 else np.arange(e - s)[::-1]
            yield out(2, e - s, side=np.full(e - s, side, np.int32), at=place, a=num[s:e], **{"pass": number[s:e]}, label=column("label").slice(s, e - s), width=width[s:e], q=q.slice(s, e - s))

    return coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _over_edges(found: DataFrame, threshold: float) -> DataFrame:
    """``a``, ``b``, ``sure``: links, and pairs to verify, between rows of different partitions."""
    spark = found.sparkSession
    sizes = sorted((r["part"], r["at"]) for r in found.where("kind = 3").select("part", "at").collect())  # a row for each partition
    met = []
    for k, (part, _) in enumerate(sizes):
        between = 0
        for other, size in sizes[k + 1 :]:
            met.append((part, other, between))
            between += size
            if between >= WINDOW:
                break
    if not met:
        return spark.createDataFrame([], "a long, b long, sure boolean")
    sides = [(p, 1, p, q, n) for p, q, n in met] + [(q, 0, p, q, n) for p, q, n in met]
    pairs = F.broadcast(spark.createDataFrame(sides, "part long, side int, x long, y long, between long"))  # neighbouring partitions
    dealt = found.where("kind = 2").drop("kind", "b").join(pairs, ["part", "side"]).where(F.col("at") + F.col("between") < WINDOW)

    def run(t: pa.Table) -> pa.Table:
        side, at, num = (t.column(c).to_numpy() for c in ("side", "at", "a"))
        p, y = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        between = t.column("between")[0].as_py()
        key = [t.column(c).to_pylist() for c in ("pass", "label", "width")]
        own = lambda at: {tuple(c[k] for c in key) for k in at.tolist()}
        if not len(p) or not len(y) or own(p) != own(y):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "sure": pa.array([], pa.bool_())})
        q = t.column("q").combine_chunks()
        unit = len(q[0].as_buffer()) - 8
        (x, ex), (z, ez) = (_steps(q.take(pa.array(k)), unit) for k in (p, y))
        i, j, sure = _near(x, ex, z, ez, threshold)
        kept = at[p[i]] + at[y[j]] + between < WINDOW
        i, j, sure = i[kept], j[kept], sure[kept]
        root = _roots(len(p) + len(y), i[sure], j[sure] + len(p))
        every = np.concatenate([p, y])
        at = np.flatnonzero(root != np.arange(len(root)))
        open_ = np.flatnonzero(~sure)
        open_ = open_[root[i[open_]] != root[j[open_] + len(p)]]
        a, b = np.concatenate([every[at], p[i[open_]]]), np.concatenate([every[root[at]], y[j[open_]]])
        return pa.table({"a": pa.array(num[a]), "b": pa.array(num[b]), "sure": pa.array(np.arange(len(a)) < len(at))})

    return dealt.groupBy("x", "y").applyInArrow(run, "a long, b long, sure boolean")


def _verified(pairs: DataFrame, classes: DataFrame, threshold: float, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool((_unit([x], kind) @ _unit([y], kind).T)[0, 0] >= threshold) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: classes.select(F.col("num").alias(x), F.col("v").alias(f"v{x}"))
    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def _compared(members: DataFrame, threshold: float, kind: str, rooted: bool) -> DataFrame:
    """``num``, ``links``, ``root`` of vectors (``group``, ``num``, ``m``, ``v``) that are all compared
    with the others of their group. Each pair of tiles gives its own; ``root`` only if ``rooted``.

    Small groups share a task by their hash (``part``), large ones are dealt out by pairs of tiles."""
    sizes = store(members.groupBy("group").agg(F.count("*").alias("size")).withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")), "sizes")
    parts = max(1, math.ceil((sizes.where("tiles = 1").agg(F.sum("size")).first()[0] or 0) / (TILE // 4)))
    dealt = members.join(sizes.select("group", "tiles"), "group").withColumn("tile", F.pmod(F.xxhash64("num"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("x", F.least("tile", "other")).withColumn("y", F.greatest("tile", "other"))
    part = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("group"), F.lit(parts))).otherwise(-1 - F.col("group"))

    def run(t: pa.Table) -> pa.Table:
        group, num, m, tile = (t.column(c).to_numpy() for c in ("group", "num", "m", "tile"))
        cross = t.column("x")[0].as_py() != t.column("y")[0].as_py()
        raw = t.column("v").to_pylist()
        order = np.argsort(group, kind="stable")
        links, root = np.zeros(len(num), np.int64), np.arange(len(num))
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(own) < 2:
                continue
            x, joined = _unit([raw[k] for k in own.tolist()], kind), np.arange(len(own))
            for a in range(0, len(own), 256):
                near = x[a : a + 256] @ x.T >= threshold
                near[np.arange(len(near)), np.arange(a, a + len(near))] = False
                if cross:
                    near &= tile[own[a : a + 256], None] != tile[own]
                links[own[a : a + 256]] += near @ m[own]
                if rooted:
                    i, j = np.nonzero(near)
                    pair = np.unique(joined[i + a] * len(own) + joined[j])
                    joined = _roots(len(own), *np.divmod(pair, len(own)))[joined]
            root[own] = own[joined]
        return pa.table({"num": pa.array(num), "links": pa.array(links), "root": pa.array(num[root])})

    return dealt.select(part.alias("part"), "group", "num", "m", "v", "tile", "x", "y").groupBy("part", "x", "y").applyInArrow(run, "num long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every vector.

    ``exact``: compares all vectors of a label with each other, in blocks, instead of sorted windows.
    """
    spark = vectors.sparkSession
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    every = _prepared(vectors, id_col, vector_col, label_col, kind)
    distinct = every.where("v is not null").groupBy("label", "digest").agg(F.min("id").alias("cls"), F.count("*").alias("m"), F.first("v").alias("v"))
    classes = store(distinct.withColumn("width", F.length("v")).withColumn("num", F.monotonically_increasing_id()), "classes")
    # codes of vectors of different labels or lengths never meet
    sizes = classes.groupBy("label", "width").agg(F.count("*").alias("n"), F.min("num").alias("group"))
    if exact:
        members = classes.join(sizes.select("label", "width", "group"), ["label", "width"]).select("group", "num", "m", "v")
        counted = store(_compared(members, threshold, kind, True), "counted")
        roots = components(counted.select(F.col("num").alias("a"), F.col("root").alias("b")))
    else:
        largest, total = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        passes = passes_for(largest, threshold)
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total * passes // (8 * WINDOW)), total * passes // PART_ROWS)
        found = store(_scanned(_coded(classes, passes, kind), parts, threshold), "found")
        edges = store(_over_edges(found, threshold), "edges")
        links = found.where("kind = 0").select("a", "b").union(edges.where("sure").select("a", "b"))
        open_ = found.where("kind = 1").select("a", "b").union(edges.where("not sure").select("a", "b"))
        roots = components(links.union(_verified(open_, classes, threshold, kind)))
        discard(found, edges)
        members = roots.select(F.col("v").alias("num"), F.col("root").alias("group")).join(classes.select("num", "m", "v"), "num")
        counted = _compared(members, threshold, kind, False)
    links = counted.groupBy("num").agg(F.sum("links").alias("links"))
    rooted = classes.select("label", "digest", "cls", "m", "num").join(roots.withColumnRenamed("v", "num"), "num", "left").withColumn("root", F.coalesce("root", "num"))
    least = rooted.groupBy("root").agg(F.min("cls").alias("least"))
    known = rooted.join(links, "num", "left").join(least, "root").select("label", "digest", "m", "links", "least")
    rows = every.select("id", "label", "digest").join(known, ["label", "digest"], "left")
    component = F.coalesce("least", "id")
    return rows.select(
        F.col("id").alias(id_col), F.when(F.col("m").isNull(), 0).otherwise(F.col("m") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
