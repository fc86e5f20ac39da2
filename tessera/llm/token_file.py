"""A compressed file of token ids, in document order, that Spark writes and reads.

Layout, below one folder: ``codebook`` has one row, the canonical code lengths of the ids that occur
anywhere; ``blocks`` has a row per block of whole documents: the number of all ids before it, its
documents' ids and numbers of token ids, bit-offset checkpoints and the coded bits. A block can be
decoded with the code book alone. Blocks hold about ``BLOCK_IDS`` ids or one longer document.

Writing: documents are range-partitioned and sorted by id; token ids are computed once and written;
their global counts (one row per id of the vocabulary) give the code book; then blocks are coded.

Null and empty texts have the end id alone. Equal ``doc_id`` stand together, ordered by a hash of the
text, then by text, over as many partitions as they need; a null one comes first. Other columns are ignored. An empty table gives a file without blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import huffman
from tessera.llm.memory import released
from tessera.llm.storage import discard, new_path, store
from tessera.llm.tokens import BYTE_BPE, encode

END_ID = 0
BLOCK_IDS = 1 << 16
#: Chunks the encoder remembers here: this operator keeps little else in memory.
MEMORY_CHUNKS = 1_300_000


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Stored rows ``part``, ``at`` (ids before it in its part), ``doc``, ``n``, ``ids`` in order."""
    doc_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("at", T.LongType()), T.StructField("doc", doc_type), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, flat, bounds in encode(batch.column(1), tokenizer, MEMORY_CHUNKS):
                n = np.diff(bounds) + 1
                ids = np.insert(flat, bounds[1:], end_id)
                wide = len(ids) and ids.max() > 0xFFFF
                raw = ids.astype("<u4" if wide else "<u2")
                unit = raw.itemsize
                ends = np.cumsum(n)
                offsets = np.concatenate([[0], ends]).astype(np.int64) * unit
                column = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), pa.array(at + ends - n), batch.column(0).slice(i, len(n)), pa.array(n), column], names=schema.names)
                at += int(ends[-1]) if len(ends) else 0

    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))  # deals out the texts of a repeated id
    ready = docs.select(id_col, text_col).repartitionByRange(F.col(id_col).asc_nulls_first(), tie).sortWithinPartitions(F.col(id_col).asc_nulls_first(), tie, F.col(text_col))
    return store(ready.mapInArrow(released(run), schema), "tokens", "zstd")


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _counts(tokens: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = np.bincount(_ids(raw.as_buffer(), n))
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = tokens.select("n", "ids").mapInArrow(released(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # one row per id of the vocabulary
    out = np.zeros(int(rows.id.max()) + 1 if len(rows) else 1, np.int64)
    out[rows.id.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return out


def write(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token ids of all documents, in ascending order of ``id_col``, below ``path``."""
    spark = docs.sparkSession
    tokens = token_table(docs, tokenizer, end_id, id_col, text_col)
    lengths = huffman.code_lengths(_counts(tokens))
    parts = {r["part"]: r["ids"] for r in tokens.groupBy("part").agg(F.sum("n").alias("ids")).collect()}  # one row per partition
    before, first = 0, {}
    for part in sorted(parts):
        first[part] = before
        before += parts[part]
    book = spark.sparkContext.broadcast((lengths, huffman.canonical_codes(lengths), first))
    doc_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("start", T.LongType()), T.StructField("docs", T.ArrayType(doc_type)), T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("checkpoints", T.BinaryType()), T.StructField("bits", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, codes, first = book.value
        types = [pa.int64(), pa.list_(pa.null()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        for batch in batches:
            types[1] = pa.list_(batch.schema.field("doc").type)
            part, at, n = (batch.column(c).to_numpy() for c in (0, 1, 3))
            docs_, raw = batch.column(2).to_pylist(), batch.column(4)
            rows, i = [], 0
            while i < len(n):
                j, total = i, 0
                while j < len(n) and part[j] == part[i] and (j == i or total + n[j] <= BLOCK_IDS):
                    total += n[j]
                    j += 1
                ids = np.concatenate([_ids(raw[k].as_buffer(), n[k]) for k in range(i, j)])
                bits, marks = huffman.encode(ids, sizes, codes)
                rows.append((first[int(part[i])] + int(at[i]), docs_[i:j], n[i:j].tolist(), marks, bits))
                i = j
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    tokens.mapInArrow(released(run), schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(tokens)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")


def _decoded(spark: SparkSession, path: str, emit, fields: list[T.StructField]) -> DataFrame:
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()[0]), np.uint8)
    table = spark.sparkContext.broadcast(huffman.decode_table(lengths))
    blocks = spark.read.parquet(f"{path}/blocks")
    doc_type = blocks.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", doc_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, batch.num_rows, 32):
                part = batch.slice(x, 32)
                sizes = part.column(2).to_pylist()
                ids = huffman.decode(part.column(4).to_pylist(), part.column(3).to_pylist(), [sum(s) for s in sizes], table.value)
                n = part.column(2).flatten().to_numpy()
                start = np.concatenate([first + np.cumsum([0, *s[:-1]]) for first, s in zip(part.column(0).to_pylist(), sizes, strict=True)])
                out = []
                for own, block in zip(sizes, ids, strict=True):
                    ends = np.cumsum(own).tolist()
                    out += [emit(block[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1).flatten(), pa.array(start), pa.array(n), pa.array(out)], names=schema.names)

    return blocks.mapInArrow(released(run), schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) of a file."""
    return _decoded(spark, path, lambda ids: ids.astype("<u4").tobytes(), [T.StructField("ids", T.BinaryType())])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of a file, from its decoded ids."""
    return _decoded(spark, path, lambda ids: zlib.crc32(np.ascontiguousarray(ids, "<u4")), [T.StructField("ids_crc32", T.LongType())])


def round_trip(docs: DataFrame, **given) -> DataFrame:
    """Writes a file in the shared folder and returns what :func:`digests` reads from it."""
    path = new_path(docs.sparkSession, "token-file")
    write(docs, path, **given)
    return digests(docs.sparkSession, path)
