"""Conflict-constrained best-fit packing (operator 3).

Documents (pieces of them, if longer than a bin) are dealt by hash into groups
of bounded size; each group is packed by best-fit in decreasing length.  Bins are
ordered by residual room; a bin carries a bitmap of the sources and duplicate
clusters in it, and takes no piece of a source or cluster it holds.  The search
starts at the tightest residual that fits and goes on to the next until a
compatible bin is found; a tree over the residuals, whose nodes hold the AND of
the bitmaps below them, skips runs of bins that all conflict.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, words_of

CAPACITY = 2048
#: pieces packed together; a group's loss is a few half-filled bins
GROUP_ROWS = 5_000


class Bins:
    """Open bins by residual room, with conflict bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()  # residuals 0..capacity
        self.all = [-1] * (2 * self.leaves)  # AND of the bitmaps below; -1: no bin
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # residual: (bitmap, bin)
        self.used = 0

    def _refresh(self, residual: int) -> None:
        both = -1
        for bitmap, _ in self.at[residual]:
            both &= bitmap
        node = residual + self.leaves
        while True:
            if self.all[node] == both:
                return
            self.all[node] = both
            node >>= 1
            if not node:
                return
            both = self.all[2 * node] & self.all[2 * node + 1]

    def _seek(self, low: int, bits: int) -> tuple[int, int] | None:
        """(residual, place) of the tightest compatible bin with room ``low``."""
        def down(node: int, lo: int, hi: int):
            # -1 has every bit: an empty part conflicts with anything that has a bit
            if hi < low or lo > self.capacity or self.all[node] == -1 or self.all[node] & bits:
                return None
            if lo == hi:
                for place, (bitmap, _) in enumerate(self.at[lo]):
                    if not bitmap & bits:
                        return lo, place
                return None
            mid = (lo + hi) // 2
            return down(2 * node, lo, mid) or down(2 * node + 1, mid + 1, hi)

        return down(1, 0, self.leaves - 1)

    def place(self, length: int, bits: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece."""
        found = self._seek(length, bits)
        if found is None:
            number, bitmap, room = self.used, 0, self.capacity
            self.used += 1
        else:
            room, place = found
            bitmap, number = self.at[room].pop(place)
            self._refresh(room)
        self.at[room - length].append((bitmap | bits, number))
        self._refresh(room - length)
        return number, self.capacity - room


def pack_group(lengths: list[int], conflicts: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, given in the order to be packed.  A conflict is
    a tuple of labels (None: none); labels in the same place must differ within a bin."""
    bins, bit_of = Bins(capacity), {}
    out = []
    for length, labels in zip(lengths, conflicts):
        bits = 0
        for i, label in enumerate(labels):
            if label is not None:
                bits |= 1 << bit_of.setdefault((i, label), len(bit_of))
        out.append(bins.place(length, bits))
    return out


def _packer(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group, then longest first."""
        rows: list[tuple] = []

        def packed():
            # a cluster of one piece has no conflict and needs no bit
            count: dict = {}
            for r in rows:
                count[r[5]] = count.get(r[5], 0) + 1
            labels = [(r[4], r[5] if count[r[5]] > 1 else None) for r in rows]
            placed = pack_group([r[1] for r in rows], labels, capacity)
            columns = [[r[2] for r in rows], [r[3] for r in rows], [r[1] for r in rows],
                       [(rows[0][0] << 32) + b for b, _ in placed], [o for _, o in placed]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                              ["doc_id", "piece", "length", "bin", "offset"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[0] != rows[0][0]:
                    yield packed()
                    rows = []
                rows.append(row)
        if rows:
            yield packed()

    return run


def best_fit(docs: DataFrame, length: Column, doc_id: str = "doc_id", source: str = "source",
             cluster: Column | None = None, capacity: int = CAPACITY,
             group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, piece, length, bin, offset): the place of every piece.

    A document longer than ``capacity`` is cut into pieces of that length and a
    rest.  Two pieces of one source, or of one duplicate cluster (default: equal
    texts), never share a bin; a null source or cluster conflicts with none.
    Lengths under 1 (or null) count 1.  Ties in length go by doc_id and piece.
    Repeated rows are packed as often as they come; null doc_ids are kept.  Every
    row is dealt by a number of its own, written once, so no group holds all rows
    that agree in doc_id and length; so the groups follow the layout of the files,
    and each is packed the same way whenever it is read.  An empty table gives no rows.
    """
    cluster = F.xxhash64("text") if cluster is None else cluster
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("long").alias("n"),
                       F.col(source).cast("string").alias("source"), cluster.cast("long").alias("cluster"))
    # written, so that the numbers stay the same whenever they are read
    rows = materialize(rows.withColumn("nth", F.monotonically_increasing_id()), "lengths")
    pieces = rows.select("doc_id", "n", "source", "cluster", "nth", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("piece"))
    pieces = pieces.withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity))
    total = rows.agg(F.sum(F.floor((F.col("n") - 1) / capacity) + 1)).first()[0] or 0
    n_groups = max(1, math.ceil(total / group_rows))
    group = F.pmod(F.xxhash64("doc_id", "piece", "length", "nth"), F.lit(n_groups))
    dealt = (pieces.select(group.alias("g"), "length", "doc_id", "piece", "source", "cluster")
             .repartition(n_groups, "g").sortWithinPartitions("g", F.desc("length"), "doc_id", "piece"))
    return map_batches(dealt, _packer(capacity), "doc_id long, piece long, length long, bin long, offset long")


def word_length(text: str = "text") -> Column:
    """Words of a text and one for its end."""
    return F.size(words_of(F.col(text))) + 1
