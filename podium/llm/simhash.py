"""SimHash near-duplicates (operator 7).

Fingerprints are computed per text; equal ones collapse.  The distinct
fingerprints within a Hamming distance are found by the general pigeonhole
principle:

1. Correlated bits are grouped into partitions, from the bits' correlations over
   all fingerprints.
2. Thresholds t_i, unequal per partition, with sum t_i = d - m + 1 (t_i = -1: the
   partition is not probed) are allocated by dynamic programming on the
   estimated number of candidates of each partition and threshold.  Two
   fingerprints within d bits differ by at most t_i bits in some partition i.
3. Every fingerprint is stored under its own value of each probed partition and
   asks for all values within t_i bits of it.
4. A bucket's members are compared exactly, block against block.  A block pair
   returns links that join the same members as all its links do (a spanning
   forest), so a dense group costs rows in proportion to its members.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, map_batches, materialize, task_count

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: members of a bucket compared in one go
BLOCK = 1024
#: fingerprints of a task: each becomes many probes
TASK_PRINTS = 10_000, 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set if over half the hashes of the word shingles set it."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    first = np.concatenate([[0], ends[:-1]])[: len(words) - k + 1].tolist()
    last = (ends[k - 1:] - 1).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(first, last)], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_hash(text: Column) -> Column:
    """Tells the rows of one doc_id apart (null: as if empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp) of every row: its text hash, and its fingerprint as a signed
    long.  A null or wordless text has fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                fp = [_signed(fingerprint(t, shingle)) for t in c.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(fp, pa.int64())],
                                                 ["doc_id", "th", "fp"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("th"),
                                   F.col(text).alias("text")), run, "doc_id long, th long, fp long")


def bit_correlations(fps: DataFrame) -> np.ndarray:
    """64 x 64 absolute correlations of the bits over all of ``fps`` (summed per
    task, 65 rows each, then over tasks)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 64))
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little").astype(np.float32)
            total[:64] += bits.T @ bits
            total[64] += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(65), pa.int32()), pa.array(total.tolist())], ["i", "n"])

    rows = (map_batches(fps.select("fp"), run, "i int, n array<double>")
            .groupBy("i").agg(*[F.sum(F.col("n")[j]).alias(f"b{j}") for j in range(64)]).orderBy("i").collect())
    if not rows or not rows[64][1]:
        return np.eye(64)
    table = np.array([r[1:] for r in rows])
    n, both = table[64, 0], table[:64]
    p = np.diag(both) / n
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    return np.abs(np.divide(both / n - np.outer(p, p), spread, out=np.zeros((64, 64)), where=spread > 0))


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near-equal width: each takes a free bit and then the free
    bits most correlated with those it has."""
    free, out = list(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        part = [max(free, key=lambda b: (correlation[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < width:
            best = max(free, key=lambda b: (correlation[b, part].sum(), -b))
            part.append(best)
            free.remove(best)
        out.append(sorted(part))
    return out


def _value(bits: list[int]):
    """Column of the bits of fp that belong to a partition, packed into a long."""
    return sum((F.shiftright("fp", b).bitwiseAND(1) * F.lit(1 << i).cast("long") for i, b in enumerate(bits)),
               F.lit(0).cast("long"))


def allocate(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds t_i >= -1 of least total cost with sum t_i = distance - m + 1;
    costs[i][t + 1] is the cost of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, len(row) - 1):
                found = (cost + row[t + 1], [*chosen, t])
                if total + t not in step or found < step[total + t]:
                    step[total + t] = found
        best = step
    return best[distance - len(costs) + 1][1]


def plan_partitions(fps: DataFrame, distance: int, sizes=range(2, 9)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the probed partitions, of the cheapest plan.

    A partition's candidates at threshold t are estimated as ball(t) * sum of
    squared value counts (a bound, by the Cauchy-Schwarz inequality); to these
    come the ball(t) probes of each fingerprint, priced as PROBE candidates
    each.  One row per plan and partition reaches the driver.
    """
    probe = 64
    correlation = bit_correlations(fps)
    plans = {m: group_bits(correlation, m) for m in sizes if m <= distance + 1}
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), _value(bits).alias("v"))
                                 for m, parts in plans.items() for i, bits in enumerate(parts)]))
    squares = {(r.m, r.i): (r.n, r.s) for r in fps.select(values.alias("x")).groupBy("x").count()
               .groupBy("x.m", "x.i").agg(F.sum("count").alias("n"),
                                          F.sum(F.col("count").cast("double") * F.col("count")).alias("s")).collect()}
    cheapest = None
    for m, parts in plans.items():
        costs = []
        for i, bits in enumerate(parts):
            n, s = squares.get((m, i), (1, 1.0))  # an empty table: plan as for one fingerprint
            ball = [sum(math.comb(len(bits), k) for k in range(t + 1)) for t in range(distance + 1)]
            costs.append([0.0, *(b * (s + probe * n) for b in ball)])
        chosen = allocate(costs, distance)
        total = sum(row[t + 1] for row, t in zip(costs, chosen))
        if cheapest is None or total < cheapest[0]:
            cheapest = (total, [(bits, t) for bits, t in zip(parts, chosen) if t >= 0])
    return cheapest[1]


def _components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member joined to it) over the links a - b: as many rows as
    members, joining what the links join."""
    members, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a):]
    label = np.arange(len(members))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            own = label != np.arange(len(members))
            return members[own], members[label[own]]


def _close(fp: np.ndarray, asks: np.ndarray, group: np.ndarray, distance: int, at_once: int = 1 << 21):
    """Links between asking and stored members of the same group, compared in numpy."""
    n = int(group[-1]) + 1
    ours, theirs = fp[asks], fp[~asks]
    n_theirs = np.bincount(group[~asks], minlength=n)
    start = np.cumsum(n_theirs) - n_theirs
    g = group[asks]
    per, first = n_theirs[g], start[g]
    ends = np.cumsum(per)
    lo = 0
    while lo < len(ours):
        base = int(ends[lo] - per[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + at_once, side="right")))
        a = np.repeat(np.arange(lo, hi), per[lo:hi])
        b = np.arange(len(a)) - np.repeat(ends[lo:hi] - per[lo:hi] - base, per[lo:hi]) + first[a]
        near = np.bitwise_count(ours[a].view(np.uint64) ^ theirs[b].view(np.uint64)) <= distance
        x, y = ours[a[near]], theirs[b[near]]
        yield x[x != y], y[x != y]
        lo = hi


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group; a group may go on in the next batch."""
        rest: list[np.ndarray] | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                rows, rest = rest, None
                if rows is None:
                    return
            else:
                rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if rest is not None:
                    rows = [np.concatenate(p) for p in zip(rest, rows)]
                if not len(rows[0]):
                    continue
            new = np.zeros(len(rows[0]), bool)
            for key in rows[:4]:
                new[1:] |= key[1:] != key[:-1]
            cut = len(new)
            if batch is not None:
                cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
                rest = [c[cut:] for c in rows]
            if cut:
                found = [_components(a, b) for a, b in _close(rows[4][:cut], rows[5][:cut].astype(bool),
                                                              np.cumsum(new[:cut]), distance) if len(a)]
                if found:
                    a, b = _components(*(np.concatenate(x) for x in zip(*found)))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def near_links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that join the same
    fingerprints as all pairs within ``distance`` bits do."""
    parts = plan_partitions(fps, distance)
    stored, asking = [], []
    for i, (bits, t) in enumerate(parts):
        value = _value(bits)
        flips = [sum(1 << j for j in c) for k in range(t + 1) for c in itertools.combinations(range(len(bits)), k)]
        stored.append(F.struct(F.lit(i).alias("part"), value.alias("v"), F.lit(False).alias("asks")))
        asking += [F.struct(F.lit(i).alias("part"), value.bitwiseXOR(F.lit(f).cast("long")).alias("v"),
                            F.lit(True).alias("asks")) for f in flips]
    rows = fps.select("fp", F.explode(F.array(*stored, *asking)).alias("x")).select("fp", "x.*")
    # only buckets with a stored member and another that asks are dealt out
    sizes = (rows.groupBy("part", "v").agg(F.sum(F.when(~F.col("asks"), 1).otherwise(0)).alias("n_stored"),
                                           F.count(F.lit(1)).alias("n"))
             .where("n_stored > 0 and n > 2")
             .select(F.col("part").alias("p"), F.col("v").alias("w"),
                     F.ceil(F.col("n") / F.lit(2 * block)).cast("int").alias("cuts")))
    met = rows.join(sizes, (F.col("part") == F.col("p")) & (F.col("v") == F.col("w")))
    nth = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    # a member meets every block of the other side: cuts rows each, cuts * cuts block pairs of bounded size
    met = met.select("part", "v", "fp", "asks", nth.alias("own"),
                     F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    met = met.select("part", "v", "fp", "asks",
                     F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("row"),
                     F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("col"))
    group = ["part", "v", "row", "col"]
    dealt = met.select(*group, "fp", "asks").repartition(*group).sortWithinPartitions(*group)
    return map_batches(dealt, _links(distance), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """(doc_id, th, fp, root, component_id) of every row: component_id is the
    smallest doc_id reachable over links of at most ``distance`` differing bits,
    root the smallest fingerprint there, th the text's hash.

    Null and wordless texts share fingerprint 0 and link like any other.  A
    repeated doc_id joins the components of all its rows' fingerprints only
    through equal fingerprints; a null doc_id never names a component unless no
    member has an id.  An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = materialize(prints.select("fp").distinct(), "distinct_fingerprints")
    # a small file, but every row asks many buckets
    spread = distinct.repartition(task_count(docs.sparkSession, distinct.count(), *TASK_PRINTS))
    links = materialize(near_links(spread, distance), "links")
    roots = connected_components(links)
    rooted = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(
        roots, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("f"), "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    named = rooted.join(names, F.col("root") == F.col("r")).select("f", "root", "component_id")
    return prints.join(named, F.col("fp") == F.col("f")).select("doc_id", "th", "fp", "root", "component_id")
