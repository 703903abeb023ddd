"""Canonical Huffman codes of bounded length, and vectorised coding with them."""

from __future__ import annotations

import numpy as np

STEP = 256  # ids between two bit-offset checkpoints


def code_lengths(counts: np.ndarray, longest: int = 16) -> np.ndarray:
    """Length of each symbol's code by package-merge; 0 for a symbol that never occurs.

    The longest allowed length grows if the symbols do not fit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    merged, leaf_flags = leaves, [np.ones(len(leaves), bool)]
    for _ in range(longest - 1):
        n = len(merged) // 2 * 2
        packages = merged[0:n:2] + merged[1:n:2]
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        leaf_flags.append(at < len(leaves))
    take = 2 * len(leaves) - 2
    depth = np.zeros(len(leaves), np.int64)
    for flags in reversed(leaf_flags):
        n_leaves = int(flags[:take].sum())
        depth[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, before = 0, 0
    by_length = lengths[order]
    for n in np.unique(by_length):
        code <<= int(n) - before
        same = order[by_length == n]
        codes[same] = code + np.arange(len(same))
        code, before = code + len(same), int(n)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next `width` bits: the symbol and the length of its code."""
    width = int(lengths.max(initial=1))
    symbols = np.zeros(1 << width, np.uint32)
    used = np.zeros(1 << width, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.left_shift(1, width - lengths[order].astype(np.int64))
    n = int(spans.sum())
    symbols[:n] = np.repeat(order, spans)
    used[:n] = np.repeat(lengths[order], spans)
    return symbols, used, width


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of all codes, most significant first, and the bit offset of every STEP-th id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    total = int(ends[-1]) if len(ends) else 0
    word = starts >> 5
    value = codes[ids].astype(np.uint64) << (64 - n - (starts & 31)).astype(np.uint64)
    size = (total + 31) // 32 + 2
    # Parts of different codes share no bit, so a sum below 2**32 in doubles is exact.
    out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), size)
    out += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    return out.astype(">u4").tobytes(), starts[::STEP].astype("<u8")


def decode(data: bytes, checkpoints: np.ndarray, n: int, table) -> np.ndarray:
    """All n ids; the stretches between checkpoints are decoded side by side."""
    symbols, used, width = table
    words = np.frombuffer(data, ">u4").astype(np.uint64)
    at = checkpoints.astype(np.int64)
    out = np.empty((STEP, len(at)), np.uint32)
    for k in range(STEP):
        if k == n - (len(at) - 1) * STEP:  # the last stretch may be shorter
            at = at[:-1]
        if not len(at):
            break
        w = at >> 5
        window = (words[w] << np.uint64(32)) | words[w + 1]
        shift = (64 - width - (at & 31)).astype(np.uint64)
        key = ((window >> shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        out[k, : len(at)] = symbols[key]
        at = at + used[key]
    return out.T.ravel()[:n]
