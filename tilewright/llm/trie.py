"""Prefix trie of conversations: level by level down, then level by level up.

A node is a distinct sequence of first turns. Going down, the conversations that still share their node are
grouped by (parent node, next turn); the group is a node, named by its smallest conversation. Conversations
with equal turns throughout are one class from the start, and a class that is alone in its node retires:
all its deeper nodes are its own and follow from its turns. Going up, each level's leaves and savings are
summed into the level above.

Texts are read once, for the hash and length of each turn, and never shuffled. Two turns count as equal if
their SHA-256 digests are, two conversations if 256 bits of hashes over all their turns are.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, crc_sql, cut, drop

#: Levels that Spark always builds one by one. Deeper ones are built within tasks, a node's in one, if a count shows
#: that all turns below them are no more than so many.
DEEP, FEW_TURNS = 12, 500_000
#: Levels for which a class takes its next turns along at once.
STRIDE = 8

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]
#: Length of the pieces in which a list of ids is hashed.
_PIECE = 100_000


def _running(rows: DataFrame, key: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the key's rows up to this one; a hot key's rows lie in several tasks.

    Rows are dealt by ranges of (key, order) and summed within each; what a key has in the ranges before
    comes from one row a range.
    """
    dealt = rows.withColumn("_value", value.cast("long")).repartitionByRange(F.col(key).asc_nulls_first(), *order)
    dealt = cut(dealt.withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part", key).agg(F.sum("_value").alias("_sum"))
    ends = sums.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("_sum", key).alias("n")).orderBy("_part").collect()
    carried, held = [], (None, 0)
    for part in ends:  # one row for each shuffle partition
        before = held[1] if held[0] == part["first"] else 0
        carried.append((part["_part"], part["first"], before))
        held = (part["last"], part["n"] + (before if part["first"] == part["last"] else 0))
    carried = rows.sparkSession.createDataFrame(carried, "_part int, _first long, _before long")
    within = F.sum("_value").over(Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = F.when(F.col(key) == F.col("_first"), F.col("_before")).otherwise(0)
    return dealt.withColumn(name, within).join(F.broadcast(carried), "_part").withColumn(name, F.col(name) + before).select(*rows.columns, name)


def keyed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, at, key, n_bytes: each turn's place in its conversation from 0, the digest of (role, text), the text's bytes.

    Turns are in ascending order, null first; equal ones in the order of their digests, so that reruns agree.
    A null role or text is empty. Rows without conv_id belong to no conversation and are left out. Other
    columns are not looked at.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(both.cast("binary"), 256)).alias("key"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    numbered = _running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("key")], F.lit(1), "at")
    return numbered.select("conv_id", (F.col("at") - 1).alias("at"), "key", "n_bytes")


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of keyed turns."""
    return turns.groupBy("conv_id").agg((F.max("at") + 1).alias("n_turns"))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n_turns) and keyed turns, where the first h turns are those of another conversation.

    h is crc32 of the id's decimal digits modulo ``most``, the other conversation is conv_id - conv_id % ``group``
    (with the sign of the id, as in SQL); it gives as many turns as it has, none if there is no such
    conversation. What is left may have no turn.
    """
    lengths = conversations(turns)
    heads = lengths.select(
        "conv_id", "n_turns", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    )
    plan = cut(
        heads.join(lengths.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("_n")), "base", "left")
        .select("conv_id", "n_turns", "h", "base", F.least("h", F.coalesce("_n", F.lit(0))).alias("given"))
    )
    own = turns.join(plan.select("conv_id", "h", "given"), "conv_id").where("at >= h")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("given")).alias("at"), "key", "n_bytes")
    lent = turns.where(F.col("at") < most - 1).withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "given"), "base").where("at < given")
    convs = plan.select("conv_id", (F.col("given") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_turns"))
    return convs, own.unionByName(lent.select("conv_id", "at", "key", "n_bytes"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, first, ids joined by commas) of stretches of sorted (rep, conv_id)."""
    for batch in batches:
        held: dict[int, list[int]] = defaultdict(list)
        for rep, conv in zip(batch.column("rep").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            held[rep].append(conv)
        rows = [(rep, ids[i], ",".join(map(str, ids[i : i + _PIECE]))) for rep, ids in held.items() for i in range(0, len(ids), _PIECE)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["rep", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each rep's pieces, joined by commas; pieces come sorted, one is held at a time."""

    def out(rep: int, made: hashlib._Hash) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([made.hexdigest()])], names=["rep", "ends_sha256"])

    rep, made = None, None
    for batch in batches:
        for next_rep, ids in zip(batch.column("rep").to_pylist(), batch.column("ids"), strict=True):
            if next_rep != rep:
                if made is not None:
                    yield out(rep, made)
                rep, made = next_rep, hashlib.sha256()
            else:
                made.update(b",")
            made.update(ids.as_py().encode())
    if made is not None:
        yield out(rep, made)


def _ends(members: DataFrame, classes: DataFrame, same: list[str]) -> DataFrame:
    """rep and ends_sha256 of each class: the hash of its ascending conv_ids.

    SHA-256 goes over a class's ids in one sequence, so one task hashes a class, from pieces that were put
    together before in many.
    """
    single = classes.where("n = 1").select("rep", F.sha2(F.col("rep").cast("string").cast("binary"), 256).alias("ends_sha256"))
    rows = members.join(classes.where("n > 1").select("rep", *same), same).select("rep", "conv_id")
    pieces = rows.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(_pieces, "rep long, first long, ids string")
    return single.unionByName(pieces.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "ids").mapInArrow(_hashes, "rep long, ends_sha256 string"))


def _below(depth: int):
    """Builds all levels under one node from its classes' turns, each given as (rep, n, n_turns, at, key, n_bytes)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["rep", "at", "n", "n_turns", "key", "n_bytes"]).to_pylist(), key=lambda r: (r["rep"], r["at"]))
        turns: dict[int, list[dict]] = defaultdict(list)
        for r in rows:
            turns[r["rep"]].append(r)
        top = table.column("node")[0].as_py()
        nodes = [[top, depth, None, 0, 0, 0, 0, None]]  # as _COLUMNS, and the class that ends there
        parents, live = [0], {0: list(turns)}
        while live:
            deeper: dict[int, list[int]] = {}
            for parent, reps in live.items():
                level = nodes[parent][1] - depth
                groups: dict[bytes, list[int]] = defaultdict(list)
                for rep in reps:
                    if len(turns[rep]) > level:
                        groups[turns[rep][level]["key"]].append(rep)
                for held in groups.values():
                    held_turns = [turns[rep][level] for rep in held]
                    n = sum(t["n"] for t in held_turns)
                    end = [rep for rep, t in zip(held, held_turns, strict=True) if t["n_turns"] == t["at"] + 1]
                    deeper[len(nodes)] = held
                    nodes.append([min(held), nodes[parent][1] + 1, nodes[parent][0], n, 0, 0, (n - 1) * held_turns[0]["n_bytes"], end[0] if end else None])
                    parents.append(parent)
            live = deeper
        for i in range(len(nodes) - 1, 0, -1):
            node, above = nodes[i], nodes[parents[i]]
            node[5] = node[5] or 1
            above[4], above[5], above[6] = above[4] + 1, above[5] + node[5], above[6] + node[6]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*nodes[1:], strict=True)], names=[*_COLUMNS, "rep"])

    return run


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, n_turns) with keyed turns (see ``keyed_turns``, ``rebuilt``).

    conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves
    (childless nodes in the subtree), saved_tokens (over the subtree, members but one times the bytes of the
    node's last text), ends_sha256 (of the ids that end there). Conversations without turns end at the root;
    no conversation at all gives no node. Repeated and long conversations need no more levels than different
    ones share. Two jobs a level go down and one goes up; a level's nodes are broadcast
    if a count shows few.
    """
    turns = cut(turns)
    marks = [F.bit_xor(F.xxhash64(F.lit(salt), "at", "key")).alias(f"h{salt}") for salt in range(4)]
    same = ["n_turns", *(f"h{salt}" for salt in range(4))]
    hashes = turns.groupBy("conv_id").agg(*marks)
    members = cut(convs.join(hashes, "conv_id", "left").fillna(0, same[1:]))
    classes = cut(members.groupBy(*same).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")))
    steps = cut(turns.join(classes.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "rep").sortWithinPartitions("at"))
    drop(turns)

    top = classes.agg(F.min("rep"), F.sum("n")).first()
    spark = turns.sparkSession
    if top[0] is None:
        return spark.createDataFrame([], f"{_NODE}, ends_sha256 string")
    shared = [spark.createDataFrame([(top[0], 0, None, top[1], 0)], "conv_id long, depth long, parent_conv_id long, n_convs long, n_bytes long")]
    live, sizes = classes.select("rep", "n", "n_turns", F.lit(top[0]).alias("node")), [1]
    alone, enders, finished = [], [], None
    depth, left = 0, 1
    while left:
        ended = F.lit(depth).cast("long").alias("depth")
        if depth >= DEEP:
            live = cut(live.select("rep", "n", "n_turns", "node"))
            below = live.join(steps.where(F.col("at") >= depth), "rep")
            if below.limit(FEW_TURNS + 1).count() <= FEW_TURNS:
                enders.append(live.where(F.col("n_turns") == depth).select(F.col("node").alias("conv_id"), ended, "rep"))
                finished = cut(below.groupBy("node").applyInArrow(_below(depth), f"{_NODE}, rep long"))
                break
            live = _with_turns(live, steps, depth)
        elif depth % STRIDE == 0:
            live = _with_turns(live.select("rep", "n", "n_turns", "node"), steps, depth)
        # The turn at this depth; classes that end here have none.
        turn = F.get("ahead", depth - F.get("ahead", F.lit(0))["at"])
        going = cut(live.select("*", turn["key"].alias("key"), turn["n_bytes"].alias("n_bytes")))
        enders.append(going.where("key is null").select(F.col("node").alias("conv_id"), ended, "rep"))
        going = going.where("key is not null")
        depth += 1
        groups = cut(
            going.groupBy("node", "key").agg(
                F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.count("*").alias("n_classes"), F.max("n_bytes").alias("n_bytes"), F.max("n_turns").alias("n_turns")
            )
        )
        several = groups.where("n_classes > 1")
        alone.append(groups.where("n_classes = 1").select(F.col("conv_id").alias("rep"), F.lit(depth).cast("long").alias("head"), F.col("node").alias("above"), F.col("n_convs").alias("n"), "n_turns"))
        left = several.limit(BROADCAST_ROWS + 1).count()
        if left:
            sizes.append(left)
            shared.append(several.select("conv_id", F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), "n_convs", "n_bytes"))
            child = _sent(several.select("node", "key", F.col("conv_id").alias("_child")), left)
            live = going.join(child, ["node", "key"]).select("rep", "n", "n_turns", F.col("_child").alias("node"), "ahead")

    alone = reduce(DataFrame.unionByName, alone)
    tails = cut(_tails(alone, steps))
    above = tails.where("depth = head").select("depth", "parent_conv_id", "n_leaves", "saved_tokens")
    if finished is not None:
        above = above.unionByName(finished.where(F.col("depth") == depth + 1).select(above.columns))
    done, found = None, []
    for level in range(len(shared) - 1, -1, -1):
        below = above.where(F.col("depth") == level + 1)
        if done is not None:
            below = below.unionByName(done.select(above.columns))
        sums = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        zero = F.lit(0).cast("long")
        done = cut(
            shared[level].join(_sent(sums, sizes[level]), "conv_id", "left").select(
                "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                F.coalesce("_leaves", F.lit(1).cast("long")).alias("n_leaves"),
                (F.coalesce("_saved", zero) + (F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
            )
        )
        found.append(done)

    ends = alone.select(F.col("rep").alias("conv_id"), F.col("n_turns").alias("depth"), "rep")
    if finished is not None:
        enders.append(finished.where("rep is not null").select("conv_id", "depth", "rep"))
        found.append(finished.select(_COLUMNS))
    ends = reduce(DataFrame.unionByName, [ends, *enders]).join(_ends(members, classes, same), "rep").drop("rep")
    nodes = reduce(DataFrame.unionByName, [*found, tails.select(_COLUMNS)])
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends, ["conv_id", "depth"], "left").select(*_COLUMNS, F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def _sent(few: DataFrame, rows: int) -> DataFrame:
    """A side of a join, broadcast if it was counted to have few rows."""
    return F.broadcast(few) if rows <= BROADCAST_ROWS else few


def _with_turns(live: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    """Adds ahead: a class's next STRIDE turns, or those that it has, in order."""
    near = steps.where((F.col("at") >= depth) & (F.col("at") < depth + STRIDE))
    ahead = near.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("at", "key", "n_bytes"))).alias("ahead"))  # at most STRIDE
    return live.join(ahead, "rep", "left")


def _tails(alone: DataFrame, steps: DataFrame) -> DataFrame:
    """The nodes of classes from the depth (``head``) on where each is alone: no branches, one leaf."""
    depth = F.col("at") + 1
    rows = steps.join(alone, "rep").where(depth >= F.col("head")).select("rep", "at", "head", "above", "n", "n_turns", "n_bytes")
    copies = _running(rows.where("n > 1"), "rep", [F.col("at").desc()], (F.col("n") - 1) * F.col("n_bytes"), "saved_tokens")
    rows = rows.where("n = 1").withColumn("saved_tokens", F.lit(0).cast("long")).unionByName(copies)
    return rows.select(
        F.col("rep").alias("conv_id"), depth.alias("depth"), F.when(depth == F.col("head"), F.col("above")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), (depth < F.col("n_turns")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved_tokens", "head",
    )


#: The query's rows by hashed prefixes; a subtree is joined through the prefixes of its nodes' smallest conversations.
TRIE_SQL = f"""
with turns as (
  select conv_id, turn, sha256(octet_length(encode(coalesce(role, '')))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as key,
    octet_length(encode(coalesce(text, ''))) as n_bytes
  from conversations where conv_id is not null
), convs as (
  select conv_id, list(key order by turn nulls first, key) as keys, list(n_bytes order by turn nulls first, key) as sizes, {crc_sql("conv_id::varchar")} % 9 as h
  from turns group by conv_id
), rebuilt as materialized (
  select c.conv_id, list_concat(coalesce(b.keys[:c.h], []), c.keys[c.h + 1:]) as keys, list_concat(coalesce(b.sizes[:c.h], []), c.sizes[c.h + 1:]) as sizes
  from convs c left join convs b on b.conv_id = c.conv_id - c.conv_id % 5
), paths as materialized (
  select conv_id, d, d = len(keys) as ends, sha256(array_to_string(keys[:d], ',')) as node,
    case when d > 0 then sha256(array_to_string(keys[:d - 1], ',')) end as above, coalesce(sizes[d], 0) as n_bytes
  from (select *, unnest(range(len(keys) + 1)) as d from rebuilt)
), nodes as materialized (
  select d, node, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(n_bytes) as own,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from paths group by d, node
), kids as (
  select above as node, count(*) as n from nodes where d > 0 group by above
), sums as (
  select p.d, p.node, sum(n.own) as saved, count(*) filter (where k.n is null) as leaves
  from nodes n left join kids k on k.node = n.node join paths p on p.conv_id = n.conv_id and p.d <= n.d group by p.d, p.node
)
select n.conv_id, n.d::bigint as depth, a.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, coalesce(k.n, 0)::bigint as n_children,
  s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, n.ends_sha256
from nodes n join sums s on s.d = n.d and s.node = n.node left join kids k on k.node = n.node left join nodes a on a.node = n.above and a.d = n.d - 1
"""
