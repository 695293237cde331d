"""Canonical length-limited Huffman codes over token ids, on numpy arrays.

``code_lengths`` is the package-merge construction; ``encode`` packs ids most
significant bit first; ``decode`` reads many independent blocks side by side,
each from its own bit offset, one table look-up per token.
"""

from __future__ import annotations

import numpy as np

#: bits of the longest code; more only where the vocabulary needs them.  The decoding
#: table has 2**longest entries and should stay in the processor's cache.
MAX_LENGTH = 16
#: tokens from one bit-offset checkpoint to the next
BLOCK = 512


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code length of each symbol (0: never used) with none over ``limit``
    (default: MAX_LENGTH, or one bit more than the symbols need)."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if limit is None:
        limit = max(MAX_LENGTH, n.bit_length() + 1)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    if n <= 1:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used].astype(np.float64)
    packages, merged = np.empty(0), []
    for _ in range(limit):
        weights = np.concatenate([coins, packages])
        order = np.argsort(weights, kind="stable")
        merged.append(order < n)  # which places hold a symbol's own coin
        weights = weights[order][: len(order) // 2 * 2]
        packages = weights[::2] + weights[1::2]
    own, take = np.zeros(n, np.uint8), 2 * n - 2
    for is_coin in reversed(merged):
        coins_taken = int(is_coin[:take].sum())
        own[:coins_taken] += 1
        take = 2 * (take - coins_taken)
    lengths[used] = own
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = previous = 0
    for length, group in ((k, order[lengths[order] == k]) for k in np.unique(lengths[order])):
        code <<= int(length) - previous
        codes[group] = code + np.arange(len(group), dtype=np.uint64)
        code, previous = code + len(group), int(length)
    return codes


class Codec:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.codes = canonical_codes(self.lengths)
        self.longest = max(1, int(self.lengths.max(initial=1)))
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids' bits, filled up to whole bytes, and the bit offset of every BLOCK-th id."""
        return self.encode_many([ids])[0]

    def encode_many(self, lists: list[np.ndarray]) -> list[tuple[bytes, np.ndarray]]:
        """``encode`` of each list, all packed in one go."""
        n = np.array([len(x) for x in lists], np.int64)
        ids = np.concatenate(lists) if lists else np.empty(0, np.uint32)
        if not len(ids):
            return [(b"", np.empty(0, np.uint32)) for _ in lists]
        size = self.lengths[ids].astype(np.int64)
        if not size.all():
            raise ValueError("an id without a code")
        ends = np.concatenate([[0], np.cumsum(size)])
        cuts = np.concatenate([[0], np.cumsum(n)])  # first id of each list
        n_bytes = (ends[cuts[1:]] - ends[cuts[:-1]] + 7) // 8
        first_byte = np.cumsum(n_bytes) - n_bytes
        inside = ends[:-1] - np.repeat(ends[cuts[:-1]], n)  # bit offset in the list
        at = inside + np.repeat(8 * first_byte, n)
        code, word, room = self.codes[ids], at >> 6, 64 - (at & 63) - size
        whole = code << np.maximum(room, 0).astype(np.uint64)
        over = np.flatnonzero(room < 0)
        whole[over] = code[over] >> (-room[over]).astype(np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        words = np.zeros(int(8 * n_bytes.sum() + 63) // 64, np.uint64)
        words[word[starts]] = np.bitwise_or.reduceat(whole, starts)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        data = words.astype(">u8").tobytes()
        marked = (np.arange(len(ids)) - np.repeat(cuts[:-1], n)) % BLOCK == 0
        marks = np.split(inside[marked].astype(np.uint32), np.cumsum(-(-n // BLOCK))[:-1])
        return [(data[a:a + k], m) for a, k, m in zip(first_byte.tolist(), n_bytes.tolist(), marks)]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        if self._table is None:
            order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
            order = order[self.lengths[order] > 0]
            spans = 1 << (self.longest - self.lengths[order].astype(np.int64))
            pad = (1 << self.longest) - int(spans.sum())
            self._table = (np.append(np.repeat(order, spans), np.zeros(pad, order.dtype)).astype(np.uint32),
                           np.append(np.repeat(self.lengths[order], spans), np.ones(pad, np.uint8)))
        return self._table

    def decode(self, data: bytes, bit_offsets: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
        """Ids of the blocks that begin at the given bit offsets and hold so many
        ids each (BLOCK at most), one block after the other."""
        symbols, lengths = self.table()
        b = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        windows = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        order = np.argsort(-n_ids, kind="stable")
        at, left = bit_offsets[order].astype(np.int64), n_ids[order]
        out = np.zeros((int(n_ids.max(initial=0)), len(order)), np.uint32)
        for step in range(out.shape[0]):
            live = int(np.searchsorted(-left, -step, side="left"))  # blocks with more than step ids
            p = at[:live]
            code = (windows[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - self.longest)
            out[step, :live] = symbols[code]
            p += lengths[code]
        rows = np.empty_like(out.T)
        rows[order] = out.T
        return rows[np.arange(out.shape[0]) < n_ids[:, None]]
