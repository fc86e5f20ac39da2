"""Token ids and token counts of whole texts with public tokenizer files, in Arrow batches.

Texts are cut into chunks on their bytes, and each distinct chunk of a batch is encoded once (and
remembered across batches, up to ``MEMORY_CHUNKS``). A cut stands before each run of white space, and
before a comma or full stop between a letter or digit and white space. Both supported vocabularies
split there whatever stands around: none of their patterns goes on from other characters into white
space, and white space before a word stays in the word's chunk, so a run is never divided. The only
runs that get no cut of their own are those that begin with white space outside ASCII. Texts longer
than a group are encoded part by part, cut at the same places, so memory follows the group and the
longest stretch without white space. All ways give the ids that the library gives for the whole text;
tests compare them.

Null is an empty text and has no ids. Only lengths leave :func:`counts`.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.memory import released
from tessera.llm.words import text_buffers

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Texts are encoded in groups of about so many bytes; a longer text makes a group of its own, and
#: is encoded in parts of this size where it can be cut.
GROUP_BYTES = 8 << 20
#: Chunks whose ids a worker remembers; beyond it starts anew.
MEMORY_CHUNKS = 1_000_000
#: Chunks that are joined for one call.
JOINED = 20_000
#: Chunks with more characters are not remembered.
LONGEST_KEPT = 64

#: Code points of letters that stay one letter under composition and lower-casing, as ranges.
_STABLE = np.array([
    (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x12F), (0x131, 0x17F), (0x400, 0x481), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
])
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: No cut after these: white space, and separators that some patterns take for it.
_BLANK = _SPACE.copy()
_BLANK[0x1C:0x20] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[0x2C, 0x2E]] = True

_workers: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes texts with one tokenizer file; kept per worker process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        keeps_space = "ByteLevel(add_prefix_space=False" in str(self.tokenizer.pre_tokenizer) and "Split" not in str(self.tokenizer.pre_tokenizer)
        tab = self.whole(["\t"])[0]
        self.tab = int(tab[0]) if keeps_space and len(tab) == 1 else -1
        self.known: dict[str, bytes] = {}
        self.memory = MEMORY_CHUNKS
        self.popular: pa.Array | None = None

    @classmethod
    def get(cls, name: str) -> "Encoder":
        path = name if os.path.sep in name else public_tokenizers.path(name)
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each text."""
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks, as bytes. With the byte vocabulary chunks of one word are joined by tabs:
        a tab beside a chunk is a token of its own, and none of them holds one."""
        out: list[bytes] = [b""] * len(chunks)
        rest = list(range(len(chunks)))
        if self.tab >= 0:
            bare = [c[1:] if c[:1] == " " else c for c in chunks]
            one = [c.split() == [c] and "<|" not in c for c in bare]
            joined = [k for k, x in enumerate(one) if x]
            rest = [k for k, x in enumerate(one) if not x]
            for i in range(0, len(joined), JOINED):
                part = joined[i : i + JOINED]
                ids = np.array(self.tokenizer.encode_batch_fast(["\t".join([chunks[k] for k in part])], add_special_tokens=False)[0].ids, np.uint32)
                cut = np.flatnonzero(ids == self.tab)
                if len(cut) != len(part) - 1:
                    raise RuntimeError("chunks are not apart")
                raw, at = ids.tobytes(), (4 * cut).tolist()
                for k, a, b in zip(part, [0, *(x + 4 for x in at)], [*at, len(raw)], strict=True):
                    out[k] = raw[a:b]
        for i in range(0, len(rest), JOINED):
            part = rest[i : i + JOINED]
            for k, ids in zip(part, self.whole([chunks[k] for k in part]), strict=True):
                out[k] = ids.tobytes()
        return out

    def _known(self, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many chunks in one array; where those of each chunk begin, and how many they are.

        Chunks that the group before shared with earlier ones are looked up in Arrow, the others by name.
        """
        if self.popular is None or self.popular.type != dictionary.type:
            self._keep(pa.array([], dictionary.type), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        at = pc.fill_null(pc.index_in(dictionary, value_set=self.popular), -1).to_numpy()
        rest = np.flatnonzero(at < 0)
        names = dictionary.take(pa.array(rest)).to_pylist()
        found = list(map(self.known.get, names))
        again = at >= 0
        again[rest] = np.fromiter((k is not None for k in found), bool, len(found))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            if len(self.known) + len(new) > self.memory:
                self.known.clear()
            for k, ids in zip(new, self._encode([names[k] for k in new]), strict=True):
                found[k] = ids
                if len(names[k]) <= LONGEST_KEPT:
                    self.known[names[k]] = ids
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), np.uint32)])
        size, start = self.size[at], self.start[at]
        size[rest] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start[rest] = len(self.flat) + np.cumsum(size[rest]) - size[rest]
        kept = np.flatnonzero(again)
        self._keep(dictionary.take(pa.array(kept)), flat[_spread(start[kept], size[kept])], size[kept])
        return flat, start, size

    def _keep(self, names: pa.Array, flat: np.ndarray, size: np.ndarray) -> None:
        """Remembers these as the popular chunks; the last place is for those that are not found."""
        self.popular, self.flat = names, flat
        self.size = np.append(size, 0)
        self.start = np.cumsum(self.size) - self.size

    def _sizes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All chunks between ``bounds``: ids of the distinct ones, where each distinct one's begin and
        how many they are, the number of every chunk, and the first chunk of every text."""
        cut, first = cuts(data, bounds)
        lo = int(bounds[0])
        texts = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data[lo : int(bounds[-1])]))
        encoded = texts.dictionary_encode()
        flat, start, size = self._known(encoded.dictionary)
        return flat, start, size, encoded.indices.to_numpy(), first

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts that lie in ``data`` from bound to bound, and where each text's begin
        (one entry more)."""
        flat, start, size, code, first = self._sizes(data, bounds)
        n = size[code]
        return flat[_spread(start[code], n)], np.concatenate([[0], np.cumsum(n)])[first]

    def lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        _, _, size, code, first = self._sizes(data, bounds)
        return np.diff(np.concatenate([[0], np.cumsum(size[code])])[first])


def _inner_cuts(d: np.ndarray) -> np.ndarray:
    """Flags of the places in bytes where a text may be cut."""
    flags = np.zeros(len(d) + 1, bool)
    if len(d) < 2:
        return flags
    space = _SPACE[d]
    at = np.flatnonzero(space[1:] & ~_BLANK[d[:-1]]) + 1
    last = d[at - 1]
    wide = np.flatnonzero(last >= 0x80)
    if len(wide):  # white space outside ASCII begins a run, too
        a, b, c = (d[np.maximum(at[wide] - k, 0)] for k in (3, 2, 1))
        run = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x80) & ((c <= 0x8F) | (c >= 0xA8) & (c <= 0xAF))
        run |= (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xEF) & (b == 0xBB) & (c == 0xBF)
        at = np.delete(at, wide[run])
    flags[at] = True
    mark = np.flatnonzero(_MARK[d[1:-1]] & space[2:]) + 1
    last = d[mark - 1]
    flags[mark[_ALNUM[last]]] = True
    mark = mark[last >= 0x80]
    if len(mark):
        a, b, c = (d[np.maximum(mark - k, 0)].astype(np.int64) for k in (3, 2, 1))
        point = np.where((b >= 0xC0) & (b < 0xE0), (b & 0x1F) << 6 | c & 0x3F, np.where((a >= 0xE0) & (a < 0xF0) & (b < 0xC0), (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F, 0))
        k = np.searchsorted(_STABLE[:, 0], point, side="right") - 1
        flags[mark[(k >= 0) & (point <= _STABLE[np.maximum(k, 0), 1])]] = True
    return flags


def cuts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin, counted from the first bound, and the first chunk of every text."""
    own = bounds - bounds[0]
    flags = _inner_cuts(data[int(bounds[0]) : int(bounds[-1])])
    flags[own] = True
    cut = np.flatnonzero(flags)
    return cut, np.searchsorted(cut, own)


def long_parts(data: np.ndarray, lo: int, hi: int, limit: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of a long text of about ``limit`` bytes, divided where it may be cut."""
    while hi - lo > limit:
        step = limit
        while True:
            found = np.flatnonzero(_inner_cuts(data[lo : min(hi, lo + step)]))
            if len(found) or lo + step >= hi:
                break
            step *= 2
        end = lo + int(found[-1]) if len(found) else hi
        yield lo, end
        lo = end
    yield lo, hi


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``start`` and are ``n`` long, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``limit`` bytes; a longer text stands alone."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def encode(column: pa.Array, name: str, memory: int = MEMORY_CHUNKS, group_bytes: int = GROUP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each group of texts: the first one's place, all ids, and where each text's begin.
    ``memory``: how many chunks to remember (about 250 bytes each)."""
    encoder = Encoder.get(name)
    encoder.memory = memory
    offsets, data = text_buffers(column)
    for i, j in groups(offsets, group_bytes):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo > group_bytes:
            flat = np.concatenate([encoder.ids(data, np.array(part))[0] for part in long_parts(data, lo, hi, group_bytes)])
            yield i, flat, np.array([0, len(flat)])
        else:
            yield i, *encoder.ids(data, offsets[i : j + 1])


def counts(docs: DataFrame, name: str = WORD_BPE, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every whole text. Narrow: no shuffle.

    Texts go to the encoder in groups balanced by bytes; those longer than a group are split at safe
    boundaries, and the parts' lengths are added. Null and empty texts count 0. Repeated rows each
    get a row; other columns are ignored; an empty table gives an empty result.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name) if os.path.sep not in name else name)
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            size = np.diff(offsets)
            tokens = np.zeros(len(size), np.int64)
            for i, j in groups(offsets, group_bytes):
                lo, hi = int(offsets[i]), int(offsets[j])
                if name.endswith(".model"):
                    texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
                    tokens[i:j] = [len(x) for x in pieces.encode(texts, num_threads=1)]
                elif hi - lo > group_bytes:
                    tokens[i] = sum(int(Encoder.get(name).lengths(data, np.array(part))[0]) for part in long_parts(data, lo, hi, group_bytes))
                else:
                    tokens[i:j] = Encoder.get(name).lengths(data, offsets[i : j + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], names=[batch.schema.names[0], "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(released(run), schema)
