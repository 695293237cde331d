"""Conversation prefix trie (operator 11).

Conversations are rebuilt so that neighbours share their first turns; a node is a
distinct sequence of first turns.  Its key is a 128-bit hash of position-tagged
turn hashes that are summed along the conversation, so a row knows its node's key
and, without its own turn, its parent's: no join builds the tree.

Subtree totals come from a centroid decomposition of the parent edges:

1. A component's centroid is its deepest node whose subtree weighs half of the
   component or more.  A node weighs its members, so the weight of its subtree is
   known from the grouping (the turns its members have from it on).  The nodes that
   weigh half or more are the path from the component's top to its centroid.
2. What lies under the centroid is found by one lookup: the node that the smallest
   member of a node passes one turn below the centroid.  That child is the top of
   the node's new component; the totals of all that are added along the path from
   the centroid to the top, and their weight is taken off it.
3. Every component halves, so all rounds are as many as the logarithm of the
   weight.  Components of at most ``COMPONENT`` weight are finished inside tasks,
   many at once, from their deepest nodes up.

Every round is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import all_of, join_summary, running_totals
from .common import map_batches, materialize, ship_package

FAMILY = 5
HEAD = 9
#: weight of a component that one task finishes, with others
COMPONENT = 20_000
#: nodes that a task finishes
TASK_NODES = 100_000
#: rows that meet one row of the other side, beyond which they are spread
HOT = 1_000
_LOW = 0xFFFFFFFF


def _head(conv_id: Column) -> Column:
    """Turns that a conversation takes from its family's first."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEAD).cast("long")


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """(c, p, n, bytes, k1, k2): turn p = 1.. of the n rebuilt turns of conversation c,
    the bytes and two hashes of its text and role, and a row p = 0 for every c.

    One ordered pass over the families gives every turn its place and the number of
    turns of all members, so that no join is needed, and no task gets a whole
    conversation.
    """
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    member = F.pmod("conv_id", F.lit(FAMILY))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        (F.col("conv_id") - member).cast("long").alias("family"), F.col("conv_id").cast("long").alias("c"), "turn",
        F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit("turn"), role, text).alias("k2"),
        F.octet_length(text).cast("long").alias("bytes"),
        *[(member == j).cast("long").alias(f"is{j}") for j in range(FAMILY)])
    placed = running_totals(turns, ["family"], [("c", True), ("turn", True), ("k1", True), ("k2", True)],
                            [f"is{j}" for j in range(FAMILY)], totals="all_")
    me = F.col("c") - F.col("family")
    place = reduce(lambda e, j: F.when(me == j, F.col(f"cum_is{j}")).otherwise(e), range(FAMILY), F.lit(0).cast("long"))
    placed = placed.withColumn("at", place)

    def length(j: int) -> Column:
        head = _head(F.col("family") + j)
        return F.least(head, F.col("all_is0")) + F.greatest(F.col(f"all_is{j}") - head, F.lit(0))

    n = reduce(lambda e, j: F.when(me == j, length(j)).otherwise(e), range(FAMILY), F.lit(0).cast("long"))
    head = _head(F.col("c"))
    own = F.struct((F.col("at") > head).alias("keep"), F.col("c").alias("c"),
                   (F.least(head, F.col("all_is0")) + F.col("at") - head).alias("p"), n.alias("n"))
    root = F.struct((F.col("at") == 1).alias("keep"), F.col("c").alias("c"), F.lit(0).cast("long").alias("p"), n.alias("n"))
    lent = [F.struct(((me == 0) & (F.col(f"all_is{j}") > 0) & (F.col("at") <= _head(F.col("family") + j))).alias("keep"),
                     (F.col("family") + j).alias("c"), F.col("at").alias("p"), length(j).alias("n")) for j in range(FAMILY)]
    out = placed.select("k1", "k2", "bytes", F.explode(F.filter(F.array(own, root, *lent), lambda x: x["keep"])).alias("x"))
    return out.select("x.c", "x.p", "x.n", F.when(F.col("x.p") > 0, F.col("bytes")).otherwise(0).alias("bytes"), "k1", "k2")


def prefix_rows(turns: DataFrame) -> DataFrame:
    """(c, p, n, bytes, id, parent): the node of the first p turns of c and its parent."""
    x = F.xxhash64("p", "k1", "k2")
    y = F.xxhash64(F.lit("prefix"), "p", "k1", "k2")
    parts = [h for z in (x, y) for h in (z.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(z, 32))]
    tagged = turns.select("c", "p", "n", "bytes", *[F.when(F.col("p") > 0, h).otherwise(F.lit(0)).alias(f"f{i}")
                                                    for i, h in enumerate(parts)])
    # sums of 32 bits each stay exact for two billion turns
    summed = running_totals(tagged, ["c"], [("p", True)], [f"f{i}" for i in range(4)])

    def key(p: Column, sums: list[Column]) -> Column:
        return F.struct(F.xxhash64(p, *sums).alias("a"), F.xxhash64(F.lit("node"), p, *sums).alias("b"))

    own = [F.col(f"cum_f{i}") for i in range(4)]
    return summed.select("c", "p", "n", "bytes", key(F.col("p"), own).alias("id"), F.when(
        F.col("p") > 0, key(F.col("p") - 1, [s - F.col(f"f{i}") for i, s in enumerate(own)])).alias("parent"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row per node; ``weight`` is that of its subtree, in members."""
    nodes = rows.groupBy("id").agg(
        F.min("c").alias("conv_id"), F.first("p").alias("depth"), F.first("parent").alias("parent"),
        F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes"),
        F.sum(F.col("n") - F.col("p") + 1).alias("weight"))
    nodes = materialize(nodes, "trie_nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("up")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(children, F.col("id") == F.col("up"), "left").select(
        *nodes.columns, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))


def join_spread(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], meets: str, hot: int = HOT) -> DataFrame:
    """Left join; ``meets`` is the number of rows of ``left`` that a row of ``right`` meets.
    The few rows that meet over ``hot`` are repeated and theirs spread, the others
    joined as they are."""
    names = [c for c in right.columns if c != meets]
    many = right.where(F.col(meets) > hot).select(*[F.col(c).alias(f"hot_{c}") for c in names])
    first = join_summary(left, many, [(a, f"hot_{b}") for a, b in on])
    got = F.col(f"hot_{on[0][1]}").isNotNull()
    alone = F.when(got, F.xxhash64(*left.columns))  # keeps served rows from meeting in one task
    few = right.where(F.col(meets) <= hot).select(*names).withColumn("none", F.lit(0).cast("long"))
    first = first.withColumn("alone", F.coalesce(alone, F.lit(0).cast("long")))
    cond = [F.col(a) == F.col(b) for a, b in on] + [F.col("alone") == F.col("none"), ~got]
    both = first.join(few, all_of(cond), "left")
    return both.select(*left.columns, *[F.coalesce(F.col(c), F.col(f"hot_{c}")).alias(c) for c in names])


def subtree_totals(nodes: DataFrame, rows: DataFrame, values: list[str], component: int = COMPONENT) -> DataFrame:
    """(id, t_<value>...) : the sum of each value over the subtree of every node."""
    sums = [f"t_{v}" for v in values]
    keep = ["id", "parent", "conv_id", "depth", "weight", "comp", *values, *sums]
    top = F.first_value("id", ignoreNulls=True)
    root = nodes.where("parent is null").agg(top.alias("r")).scalar()
    active = nodes.withColumn("comp", root)
    for v, s in zip(values, sums):
        active = active.withColumn(s, F.lit(0).cast("long"))
    active = active.select(*keep)
    passes = rows.select(F.col("c"), F.col("p"), F.col("id").alias("child"), F.col("parent").alias("over"))
    small, done = [], []
    while True:
        # the top of a component weighs most
        big = materialize(active.groupBy(F.col("comp").alias("k")).agg(F.max("weight").alias("whole"))
                          .where(F.col("whole") > component), "components")
        if big.isEmpty():
            small.append(active)
            break
        met = materialize(join_summary(active, big, [("comp", "k")]), "weighed")
        small.append(met.where("whole is null").select(*keep))
        met = met.where("whole is not null")
        on_path = 2 * F.col("weight") >= F.col("whole")
        at = F.struct(F.col("id").alias("x"), F.col("depth").alias("x_depth"), F.col("weight").alias("x_weight"),
                      *[F.col(v).alias(f"x_{v}") for v in values])
        centroids = materialize(met.where(on_path).groupBy(F.col("comp").alias("k")).agg(
            F.max_by(at, "depth").alias("at")).select("k", "at.*"), "centroids")
        met = join_summary(met.drop("k"), centroids, [("comp", "k")]).drop("k")
        # under a centroid is what passes through it; the smallest member tells
        asked = (met.where("depth > x_depth").groupBy("comp", "conv_id", "x", (F.col("x_depth") + 1).alias("next"))
                 .agg(F.count(F.lit(1)).alias("meets")))
        under = asked.join(passes, (F.col("conv_id") == F.col("c")) & (F.col("next") == F.col("p"))).where("over = x").select(
            F.col("comp").alias("u_comp"), F.col("conv_id").alias("u_conv"), "child", "meets")
        found = join_spread(met, under, [("comp", "u_comp"), ("conv_id", "u_conv")], "meets")
        found = materialize(found.withColumn("child", F.when(F.col("depth") > F.col("x_depth"), F.col("child")))
                            .drop("u_comp", "u_conv"), "parted")
        below = found.where("child is not null").groupBy(F.col("comp").alias("k")).agg(
            *[F.sum(v).alias(f"b_{v}") for v in values])
        placed = join_summary(found, below, [("comp", "k")])
        itself = F.col("id") == F.col("x")
        above = on_path & ~itself
        step = {"weight": F.when(above, F.col("weight") - F.col("x_weight")).otherwise(F.col("weight")),
                "comp": F.coalesce("child", "comp")}
        for v, s in zip(values, sums):
            got = F.coalesce(F.col(f"b_{v}"), F.lit(0))
            step[s] = F.col(s) + F.when(itself, got).when(above, got + F.col(f"x_{v}")).otherwise(F.lit(0))
        placed = materialize(placed.select(*[step.get(c, F.col(c)).alias(c) for c in keep], itself.alias("itself")), "rolled")
        done.append(placed.where("itself").select("id", *[(F.col(v) + F.col(s)).alias(s) for v, s in zip(values, sums)]))
        active = placed.where("not itself").select(*keep)
    rest = reduce(DataFrame.unionByName, small)
    return reduce(DataFrame.unionByName, [_finished(rest, values, sums), *done])


def _finished(rest: DataFrame, values: list[str], sums: list[str]) -> DataFrame:
    """Small components, whole ones dealt to tasks by their hash."""
    ship_package(rest.sparkSession)
    rest = materialize(rest.select("comp", "id", "parent", "depth", *values, *sums), "small_components")
    groups = max(1, rest.count() // TASK_NODES)
    flat = rest.select(F.pmod(F.xxhash64("comp"), F.lit(groups)).alias("task"), "id.a", "id.b",
                       F.col("parent.a").alias("pa"), F.col("parent.b").alias("pb"),
                       (F.col("id") == F.col("comp")).alias("top"), "depth", *values, *sums)
    k = len(values)

    def roll(t: pa.Table) -> pa.Table:
        a, b, up_a, up_b = (t.column(c).to_pylist() for c in ("a", "b", "pa", "pb"))
        at = {x: i for i, x in enumerate(zip(a, b))}
        top, depth = t.column("top").to_numpy(), t.column("depth").to_numpy()
        up = np.array([-1 if is_top else at[x] for is_top, x in zip(top.tolist(), zip(up_a, up_b))], np.int64)
        total = [t.column(v).to_numpy().copy() for v in values]
        order = np.argsort(-depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        for level in np.split(order, cuts):  # deepest first
            inner = level[up[level] >= 0]
            for x in total:
                np.add.at(x, up[inner], x[inner])
        out = [x + t.column(s).to_numpy() for x, s in zip(total, sums)]
        return pa.table([t.column("a"), t.column("b"), *[pa.array(x, pa.int64()) for x in out]], ["a", "b", *sums])

    totals = flat.groupBy("task").applyInArrow(roll, "a long, b long, " + ", ".join(f"{s} long" for s in sums))
    return totals.select(F.struct("a", "b").alias("id"), *sums[:k])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, c) in order: the ids c of a node as text, a row for each batch it is in."""
    for batch in batches:
        a, b, c = (x.to_numpy() for x in batch.columns)
        cuts = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1
        begin = np.concatenate([[0], cuts]).astype(np.int64) if len(a) else np.zeros(0, np.int64)
        text = c.astype(str).tolist()
        ends = [*begin[1:].tolist(), len(a)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[begin]), pa.array(b[begin]), pa.array(c[begin]),
             pa.array([",".join(text[i:j]) for i, j in zip(begin.tolist(), ends)], pa.string())], ["a", "b", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order: the digest of each node's, end to end."""
    key = sha = None
    for batch in batches:
        out = []
        for a, b, _, ids in zip(*(x.to_pylist() for x in batch.columns)):
            if (a, b) == key:
                sha.update(b"," + ids.encode())
                continue
            if key:
                out.append((*key, sha.hexdigest()))
            key, sha = (a, b), hashlib.sha256(ids.encode())
        yield _named(out)
    if key:
        yield _named([(*key, sha.hexdigest())])


def _named(rows: list[tuple]) -> pa.RecordBatch:
    a, b, h = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(h, pa.string())],
                                      ["a", "b", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the nodes where conversations end.  The ids of a node are
    range-partitioned and joined to text where they are; the digest streams over
    the pieces."""
    last = rows.where("p = n").select("id.a", "id.b", "c")
    pieces = map_batches(last.repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c"), _chunks,
                         "a long, b long, first long, ids string")
    pieces = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return map_batches(pieces, _digests, "a long, b long, ends_sha256 string").select(
        F.struct("a", "b").alias("e"), "ends_sha256")


def trie(conversations: DataFrame, component: int = COMPONENT) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (its smallest
    member), depth, parent_conv_id (null: the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, members but one times the bytes of the last
    text), ends_sha256 (of the ids of the conversations that end there).

    Conversation c takes the first h turns of c - c mod 5 (all if fewer, none if it is
    absent), h = crc32(c) mod 9, then its own turns after its first h.  Turns go by
    ``turn``, null first; ties by the hashes of role and text, so repeated rows are
    turns of their own.  A null role or text is empty; rows without conv_id are left
    out; an empty table has no node, not even a root.  Other columns are ignored.
    """
    rows = materialize(prefix_rows(rebuilt_turns(conversations)), "trie_rows")
    nodes = materialize(nodes_of(rows).withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn(
        "saved", (F.col("n_convs") - 1) * F.col("bytes")), "trie")
    totals = subtree_totals(nodes, rows, ["leaf", "saved"], component)
    parents = nodes.where("n_children > 0").select(F.col("id").alias("up"), F.col("conv_id").alias("parent_conv_id"),
                                                   F.col("n_children").alias("meets"))
    named = join_spread(nodes.select("id", "parent", "conv_id", "depth", "n_convs", "n_children"), parents,
                        [("parent", "up")], "meets")
    last = ends(rows)
    t = totals.select(F.col("id").alias("t"), "t_leaf", "t_saved")
    return (named.join(t, F.col("id") == F.col("t")).join(last, F.col("id") == F.col("e"), "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("t_leaf").alias("n_leaves"),
                    F.col("t_saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
