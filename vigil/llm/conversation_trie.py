"""A trie of conversation prefixes: which prefixes conversations share, and what sharing them saves.

A node of depth d is a sequence of d turns (role, text) with which some conversation starts; the root has none. Nodes
are named by their depth and their smallest conversation.

Construction is level-synchronous: for each depth the live conversations are grouped by (parent node, next turn), the
group's smallest conv_id names the new node, and a join deals the node out to its conversations. Then, from the deepest
level back, each level joins what its children add up to: leaves and savings. Two things keep the rounds few. Equal
conversations are one class from the start (by their length and 128 bits of hash over all turns) with its smallest id
and its size. And a class that is alone in its node leaves the loop: its further nodes are a chain, one row for each
turn, whose sums follow from running ones. So there are as many rounds as the longest prefix has turns that two
different conversations share.

Turns travel as the SHA-256 of role and text; texts are never shuffled. A group that shares a turn is aggregated before
the shuffle, and the node is dealt out by a join with a written table, which adaptive execution splits or broadcasts by
its measured size. A conversation of very many turns is numbered in parts: ranges of (id, turn) are counted, and a
part's rows start where the parts before it end.

Defined results: a null role or text is empty; rows without an id belong to no conversation; turns are in order of
``turn``, null first, equal ones by the hash of role and text, and a repeated row is a turn of its own; an empty table
gives no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.plans import scratch

#: Classes of more members than this are hashed as a stream of pieces of ``PIECE`` members.
SMALL, PIECE = 1000, 4096


def turn_key(role: Column, text: Column) -> Column:
    """What stands for a turn: the SHA-256 of its role, with its length, and its text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _running(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``at``, their number from 1 within ``conv`` in this order, and ``before``, the cost of those before."""
    spread = scratch.table(rows.repartitionByRange(F.col("conv"), *order).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("cost").alias("c"))
    starts = sums.select("conv", "part", F.sum("n").over(earlier).alias("part_n"), F.sum("c").over(earlier).alias("part_c")).filter("part_n is not null")
    own = Window.partitionBy("conv", "part").orderBy(*order)
    rows = spread.withColumns({"at": F.row_number().over(own).cast("long"), "before": F.sum("cost").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cost")})
    # few conversations lie in several parts, so this is a small table
    rows = rows.join(scratch.table(starts), ["conv", "part"], "left")
    return rows.withColumns({"at": F.col("at") + F.coalesce("part_n", F.lit(0)), "before": F.col("before") + F.coalesce("part_c", F.lit(0))}).drop("part", "part_n", "part_c")


def numbered(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, depth, key, cost) of every turn: its conversation, its number from 1, what it is known by and its bytes."""
    own = [F.col(f"`{c}`") for c in (id_col, turn_col, role_col, text_col)]
    text = F.coalesce(own[3], F.lit(""))
    rows = conversations.filter(own[0].isNotNull()).select(
        own[0].cast("long").alias("conv"), own[1].alias("turn"), turn_key(own[2], own[3]).alias("key"), F.octet_length(text).cast("long").alias("cost")
    )
    rows = _running(rows, F.asc_nulls_first("turn"), F.asc("key"))
    return rows.select("conv", F.col("at").alias("depth"), "key", "cost")


def spliced(turns: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings, made from ``numbered`` ones, and all their ids: the first h turns come from
    the first conversation of the family (conv - conv % family), the others are its own after its first h; h is the
    CRC-32 of the id in decimal modulo ``most`` + 1."""
    turns = scratch.table(turns)
    head = F.col("conv") - F.col("conv") % family
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    convs = scratch.table(turns.groupBy("conv").agg(F.max("depth").alias("n")))
    firsts = convs.select(F.col("conv").alias("head"), F.col("n").alias("head_n"))
    ids = convs.select("conv", head.alias("head"), h.alias("h")).join(firsts, "head", "left")
    ids = scratch.table(ids.select("conv", "head", "h", F.least("h", F.coalesce("head_n", F.lit(0))).alias("taken")))
    lent = turns.filter(F.col("depth") <= most).select(F.col("conv").alias("head"), "depth", "key", "cost")
    lent = ids.join(lent, "head").filter("depth <= h").select("conv", "depth", "key", "cost")
    own = turns.join(ids, "conv").filter("depth > h").select("conv", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "key", "cost")
    return lent.unionByName(own), convs.select("conv")


def _classes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, rep) of all conversations, and (rep, w, n, total): the classes of equal ones with size, turns and cost."""
    a, b = F.xxhash64("depth", "key"), F.xxhash64("key", F.lit(1), "depth")
    sums = turns.groupBy("conv").agg(F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b"), F.count("*").alias("n"), F.sum("cost").alias("total"))
    each = scratch.table(convs.distinct().join(sums, "conv", "left").fillna(0, ["a", "b", "n", "total"]))
    same = ["a", "b", "n"]
    classes = scratch.table(each.groupBy(*same).agg(F.min("conv").alias("rep"), F.count("*").alias("w"), F.max("total").alias("total")))
    return each.join(classes.select(*same, "rep"), same).select("conv", "rep"), classes.select("rep", "w", "n", "total")


def trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row per node: conv_id (its smallest conversation), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over its subtree, the cost of each node's last turn for all but one of its conversations), and
    ends_sha256 (of the ids of the conversations that end there). ``turns`` as from ``numbered``; ``convs`` (conv) names
    the conversations, those without turns included."""
    turns = scratch.table(turns)
    convs = turns.select("conv") if convs is None else convs
    members, classes = _classes(turns, convs)
    total = classes.agg(F.count("*").alias("m"), F.sum("w").alias("n"), F.min("rep").alias("root")).first()
    ends = _ends(members, classes)
    if not total["m"]:
        return _out(classes.limit(0).select(*_root(F.col("rep"))), ends)
    own = turns.join(classes.withColumnRenamed("rep", "conv"), "conv")
    reps = scratch.table(_running(own, F.asc("depth")).drop("at").sortWithinPartitions("depth"))

    rest = (F.col("w") - 1) * (F.col("total") - F.col("before"))  # what a chain from here on saves
    if total["m"] == 1:
        start = classes.select(F.col("rep").alias("conv"), F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("parent"))
        top = classes.select(
            *_root(F.col("rep")), F.col("w").alias("n_convs"), F.least("n", F.lit(1)).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
            ((F.col("w") - 1) * F.col("total")).alias("saved_tokens"), F.when(F.col("n") == 0, F.col("rep")).alias("rep"),
        )
        return _out(top.unionByName(_chains(reps, start, rest)), ends)

    live = classes.select(F.col("rep").alias("conv"), F.lit(total["root"]).alias("node"))
    ended = [classes.filter("n = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(total["root"]).alias("node"), "rep")]
    levels: list[DataFrame] = []  # level d has the groups of depth d + 1
    while True:
        depth = len(levels) + 1
        step = reps.filter(F.col("depth") == depth).join(live, "conv")
        sums = [F.min("conv").alias("child"), F.sum("w").alias("n"), F.count("*").alias("m"), F.max("cost").alias("cost"), F.max(rest).alias("rest")]
        groups = scratch.table(step.groupBy("node", "key").agg(*sums))
        levels.append(groups)
        shared = groups.filter("m > 1")
        if shared.isEmpty():
            break
        live = scratch.table(step.join(shared.select("node", "key", "child"), ["node", "key"]).select("conv", F.col("child").alias("node"), F.col("n").alias("turns")))
        ended.append(live.filter(F.col("turns") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", F.col("conv").alias("rep")))
        live = live.filter(F.col("turns") > depth).select("conv", "node")

    # back up: what the children of a level's nodes add up to
    nodes, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        kids = levels[depth].filter("m = 1").select("node", F.lit(1).cast("long").alias("leaves"), F.col("rest").alias("saved"))
        if below is not None:
            kids = kids.unionByName(below.select(F.col("parent_conv_id").alias("node"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        kids = kids.groupBy("node").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        if depth:
            own = levels[depth - 1].filter("m > 1").select(F.col("child").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), F.col("n").alias("n_convs"), "cost")
        else:
            own = classes.limit(1).select(*_root(F.lit(total["root"])), F.lit(total["n"]).alias("n_convs"), F.lit(0).cast("long").alias("cost"))
        up = own.join(kids, own["conv_id"] == kids["node"])
        below = scratch.table(up.select(*own.columns[:-1], "n_children", "n_leaves", ((F.col("n_convs") - 1) * F.col("cost") + F.col("saved")).alias("saved_tokens")))
        nodes.append(below)
    start = None
    for depth, groups in enumerate(levels, 1):
        own = groups.filter("m = 1").select(F.col("child").alias("conv"), F.lit(depth).cast("long").alias("start"), F.col("node").alias("parent"))
        start = own if start is None else start.unionByName(own)
    top = nodes[0]
    for x in nodes[1:]:
        top = top.unionByName(x)
    stop = ended[0]
    for x in ended[1:]:
        stop = stop.unionByName(x)
    top = top.join(stop.withColumnRenamed("node", "conv_id"), ["depth", "conv_id"], "left")
    return _out(top.unionByName(_chains(reps, start, rest)), ends)


def _root(conv: Column) -> list[Column]:
    return [conv.cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id")]


def _chains(reps: DataFrame, start: DataFrame, rest: Column) -> DataFrame:
    """The nodes of classes that are alone from a depth on; ``rep`` is set where the class ends."""
    rows = reps.join(start, "conv").filter("depth >= start")
    return rows.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("start"), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("w").alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        rest.alias("saved_tokens"), F.when(F.col("depth") == F.col("n"), F.col("conv")).alias("rep"),
    )


def _out(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    if "rep" not in nodes.columns:  # an empty table
        nodes = nodes.select("*", *[F.lit(0).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "rep")])
    own = F.when(F.col("rep").isNull(), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", F.sha2(F.col("rep").cast("string"), 256)))
    return nodes.join(ends, "rep", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", own.alias("ends_sha256"))


def _ends(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, sha) of classes with several members: the SHA-256 of their ids in order, joined by commas."""
    sizes = classes.filter("w > 1").select("rep", "w")
    rows = scratch.table(members.join(sizes, "rep"))
    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string"))
    small = rows.filter(F.col("w") <= SMALL).groupBy("rep").agg(F.sha2(F.array_join(ids, ","), 256).alias("sha"))
    return scratch.table(small.unionByName(_digests(rows.filter(F.col("w") > SMALL))))


def _digests(rows: DataFrame) -> DataFrame:
    """As ``_ends`` for classes of any size. Ids are sorted over the cluster and joined into pieces there; one task then
    hashes the pieces of a class one after another, since SHA-256 has no other order, and holds one at a time."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = [0, *((reps[1:] != reps[:-1]).nonzero()[0] + 1).tolist(), len(reps)]
            cuts = [(lo, min(lo + PIECE, hi)) for x, hi in zip(edges, edges[1:], strict=False) for lo in range(x, hi, PIECE)]
            text = [",".join(map(str, ids[lo:hi].tolist())) for lo, hi in cuts]
            at = [lo for lo, _ in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(ids[at]), pa.array(text, pa.string())], ["rep", "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, None
        for b in batches:
            done = []
            for own, piece in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if own != rep:
                    done += [(rep, state.hexdigest())] if state else []
                    rep, state = own, hashlib.sha256(piece.as_py().encode())
                else:
                    state.update(b"," + piece.as_py().encode())
            yield _pairs(done)
        yield _pairs([(rep, state.hexdigest())] if state else [])

    cut = rows.select("rep", "conv").repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv").mapInArrow(pieces, "rep long, first long, piece string")
    return cut.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(digests, "rep long, sha string")


def _pairs(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["rep", "sha"])


def with_turns(nodes: DataFrame, conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Nodes of the trie of ``conversations`` (as they stand) with the role and text of their last turn, null for the root."""
    own = numbered(conversations, id_col, turn_col, role_col, text_col)
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    key = turn_key(F.col(f"`{role_col}`"), F.col(f"`{text_col}`"))
    texts = conversations.select(F.col(f"`{id_col}`").cast("long").alias("conv"), key.alias("key"), role.alias("role"), text.alias("text")).dropDuplicates(["conv", "key"])
    last = own.join(texts, ["conv", "key"]).select(F.col("conv").alias("conv_id"), "depth", "role", "text")
    return nodes.join(last, ["conv_id", "depth"], "left")
