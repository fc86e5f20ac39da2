"""Canonical length-limited Huffman codes over token ids, with NumPy.

Codes are at most ``MAX_BITS`` long (package-merge gives the optimal such lengths) and canonical, so
a code book is its lengths. A block's bits are decoded through one table of 2**MAX_BITS entries, many
stretches of ``STRIDE`` ids side by side, each from its own bit offset.
"""

from __future__ import annotations

import numpy as np

MAX_BITS = 16
#: Ids between two bit-offset checkpoints.
STRIDE = 128


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths up to ``limit`` (0 for ids that do not occur)."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit into codes of {limit} bits")
    if n <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    level, is_leaf = leaf, [np.ones(n, bool)]
    for _ in range(limit - 1):
        half = len(level) // 2
        packs = level[: 2 * half : 2] + level[1 : 2 * half : 2]
        both = np.concatenate([leaf, packs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        is_leaf.append(at < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        leaves = int(flags[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes of all ids: shorter before longer, then by id."""
    codes = np.zeros(len(lengths), np.uint32)
    code, before = 0, 0
    for bits in range(1, MAX_BITS + 1):
        ids = np.flatnonzero(lengths == bits)
        code <<= bits - before
        before = bits
        codes[ids] = code + np.arange(len(ids))
        code += len(ids)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``MAX_BITS`` bits, the id that it begins with and its length."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]  # canonical order: windows ascend
    span = np.int64(1) << (MAX_BITS - lengths[used].astype(np.int64))
    ids = np.zeros(1 << MAX_BITS, np.uint32)
    bits = np.ones(1 << MAX_BITS, np.uint8)
    filled = int(span.sum())
    ids[:filled], bits[:filled] = np.repeat(used, span), np.repeat(lengths[used], span)
    return ids, bits


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """The bits of ids (from each byte's highest bit) and the checkpoints (little-endian uint32, or
    uint64 where a block has more bits than that holds)."""
    if not len(ids):
        return b"", b""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    word, shift = start >> 6, 64 - (start & 63) - size
    code = codes[ids].astype(np.uint64)
    out = np.zeros(int(end[-1] + 63 >> 6) + 1, np.uint64)
    head = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.bitwise_or.reduceat(head, first)
    over = np.flatnonzero(shift < 0)
    out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return out.byteswap().tobytes()[: int(end[-1] + 7 >> 3)], start[::STRIDE].astype("<u4" if int(end[-1]) <= 0xFFFFFFFF else "<u8").tobytes()


def decode(payloads: list[bytes], checkpoints: list[bytes], sizes: list[int], table: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The ids of blocks, from their bits, checkpoints and numbers of ids."""
    symbol, bits = table
    data = np.frombuffer(b"".join(payloads) + bytes(4 * MAX_BITS), np.uint8).astype(np.uint32)
    window = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    base = 8 * np.concatenate([[0], np.cumsum([len(p) for p in payloads])])
    wide = [len(c) > 4 * -(-n // STRIDE) for c, n in zip(checkpoints, sizes, strict=True)]
    marks = [np.frombuffer(c, "<u8" if w else "<u4").astype(np.int64) + b for c, b, w in zip(checkpoints, base[:-1].tolist(), wide, strict=True)]
    at = np.concatenate([*marks, np.zeros(0, np.int64)])
    last = 8 * len(window) - 8
    out = np.empty((STRIDE, len(at)), np.uint32)
    for k in range(STRIDE):
        w = (window[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[k] = symbol[w]
        at = np.minimum(at + bits[w], last)  # a block's last stretch may run on
    columns = np.cumsum([0, *map(len, marks)])
    return [out[:, a:b].T.reshape(-1)[:n] for a, b, n in zip(columns[:-1].tolist(), columns[1:].tolist(), sizes, strict=True)]
