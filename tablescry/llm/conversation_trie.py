"""Prefix trie of conversations by double arrays, one for each prefix shard.

Conversations are sequences of turns (role, text); a node of the trie is a sequence of first
turns that some conversation starts with. Turns are known by the MD5 of role and text, prefixes
by a rolling hash of those, computed along each conversation. Conversations of equal turns are
one sequence with a weight, so copies are folded before anything is built.

A prefix is an upper node while more than ``SHARD_ROWS`` turns lie below it; the root always is.
What is below the upper nodes falls into shards, each under one prefix, none larger than that,
however many conversations share a first turn. A task packs the shards it gets, some at a time,
into BASE and CHECK arrays over dense turn ids: the child of state s by turn t is slot
BASE[s] + t if CHECK there is s. Walking all sequences of the shard down these arrays, level by
level, gives the nodes and their members; walking the levels back up sums the subtrees. The few
upper nodes' members are summed globally; their subtrees are summed along the sequences: each
node's own part is put on its smallest member, and a sum from below along each member's path,
added over the members, is the node's total.

The members that end at a node are hashed in order by one pass over sorted rows, which holds one
hash state: SHA-256 can't be split, so the ids of one very frequent conversation go through one
task, in constant memory.

Defined cases: null role or text is empty; null turns come first; turns of equal number are
taken in order of their MD5, repeated rows are repeated turns; rows without conv_id are left
out; very long texts count by their bytes and are only hashed, very long conversations are upper
nodes down to their last SHARD_ROWS turns; other columns, whatever their names, are not looked
at; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescry.llm.common import Tables, mixed
from tablescry.plans.derived import load

SHARD_ROWS = 200_000
GROUP, HEADS = 5, 9  # conversation c takes its first crc32(c) % HEADS turns from c - c % GROUP
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, parent binary"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, nth, mark, bytes) of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", mark.alias("mark"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "mark")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("nth"), "mark", "bytes")


def rebuilt(conversations: DataFrame, tables: Tables) -> DataFrame:
    """(conv_id, depth, mark, bytes, length) of the rebuilt conversations' turns; depth 0 is the start, without text."""
    turns = tables.keep(numbered_turns(conversations))
    own = turns.groupBy("conv_id").agg(F.max("nth").alias("own"))
    base, alone = F.col("conv_id") - F.col("conv_id") % GROUP, F.col("conv_id") % GROUP == 0
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    plan = own.select("conv_id", "own", base.alias("base"), F.when(alone, 0).otherwise(taken).alias("skip"))
    plan = plan.join(own.toDF("base", "base_own"), "base", "left")
    head = F.when(alone, F.lit(0)).otherwise(F.least("skip", F.coalesce("base_own", F.lit(0))))
    plan = plan.withColumn("head", head).withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("skip"), F.lit(0)))
    plan = tables.keep(plan.select("conv_id", "base", "skip", "head", "length"))
    kept = turns.join(plan, "conv_id").where("nth > skip").select("conv_id", (F.col("nth") - F.col("skip") + F.col("head")).alias("depth"), "mark", "bytes", "length")
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("nth") < HEADS)).withColumnRenamed("conv_id", "base")
    heads = heads.join(plan.where("head > 0"), "base").where("nth <= head").select("conv_id", F.col("nth").alias("depth"), "mark", "bytes", "length")
    starts = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit("00" * 16)).alias("mark"), F.lit(0).cast("long").alias("bytes"), "length")
    return kept.unionByName(heads).unionByName(starts)


def _lanes(marks: pa.Array) -> np.ndarray:
    """Two 64-bit numbers for each 16-byte value."""
    return np.frombuffer(b"".join(marks.to_pylist()), np.uint64).reshape(-1, 2)


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    out, square, rest = np.ones(len(exponents), np.uint64), base, exponents.copy()
    while rest.any():
        out[(rest & 1) == 1] *= np.uint64(square)
        square, rest = square * square & 0xFFFFFFFFFFFFFFFF, rest >> 1
    return out


def _prefix_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows in order of conv_id and depth the key of their prefix and of the prefix one turn shorter."""
    carried, above = np.zeros(2, np.uint64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        depth, lanes = batch["depth"].to_numpy(), _lanes(batch["mark"])
        start = np.maximum.accumulate(np.where(depth == 0, np.arange(len(depth)), -1))
        keys = np.zeros((len(depth), 2), np.uint64)
        for k, base in enumerate(BASES):
            terms = mixed(lanes[:, k] + np.uint64(base)) * _power(base, depth)
            sums = np.cumsum(np.where(depth == 0, np.uint64(0), terms), dtype=np.uint64)
            sums -= np.where(start >= 0, sums[start], np.uint64(0) - carried[k])
            carried[k] = sums[-1]
            keys[:, k] = mixed(sums + depth.astype(np.uint64))
        packed = [row.tobytes() for row in keys]
        before = [above, *packed[:-1]]
        above = packed[-1]
        parents = [None if d == 0 else p for d, p in zip(depth.tolist(), before, strict=True)]
        yield pa.record_batch([*batch.columns, pa.array(packed, pa.binary()), pa.array(parents, pa.binary())], names=[*batch.schema.names, "key", "parent"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, n, ends) of each run of equal keys in rows ordered by key and conv_id: its first id, its size and the hash of its ids."""
    key, first, n, state = None, 0, 0, hashlib.sha256()
    for batch in batches:
        done = []
        for this, conv in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if this != key:
                if n:
                    done.append((first, n, state.hexdigest()))
                key, first, n, state = this, conv, 0, hashlib.sha256()
            state.update(f",{conv}".encode() if n else str(conv).encode())
            n += 1
        yield _end_rows(done)
    yield _end_rows([(first, n, state.hexdigest())] if n else [])


def _end_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    first, n, ends = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch({"conv_id": pa.array(first, pa.int64()), "n": pa.array(n, pa.int64()), "ends": pa.array(ends, pa.string())})


class DoubleArray:
    """A trie over dense ids: the child of state s by id t is slot ``base[s] + t`` if ``check`` of that slot is s.

    State 0 is the start. Children are added for whole levels at a time.
    """

    TRIES, SPARSE = 32, 4

    def __init__(self):
        self.base, self.check, self.end = np.zeros(1024, np.int64), np.full(1024, -1, np.int64), 1

    def _room(self, end: int) -> None:
        if end > len(self.base):
            more = max(end, 2 * len(self.base)) - len(self.base)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))
        self.end = max(self.end, end)

    def add(self, states: np.ndarray, ids: np.ndarray) -> None:
        """Give each state its children; (state, id) pairs are different and in order, and the states have none yet."""
        first = np.flatnonzero(np.diff(states, prepend=-1))
        count = np.diff(np.append(first, len(states)))
        low, span = ids[first], ids[first + count - 1] - ids[first] + 1
        close = span <= self.SPARSE * count
        at = self.end + np.cumsum(np.where(close, span, 0)) - np.where(close, span, 0)
        self._room(int(self.end + span[close].sum()))
        self.base[states[first[close]]] = at[close] - low[close]
        filled = np.repeat(close, count)
        self.check[self.base[states[filled]] + ids[filled]] = states[filled]
        for g in np.flatnonzero(~close).tolist():  # ids far apart: the first gaps they all fit in
            own = ids[first[g] : first[g] + count[g]] - low[g]
            gaps = np.flatnonzero(self.check[1 : self.end] < 0)[: self.TRIES] + 1
            at_gap = next((s for s in gaps.tolist() if s + own[-1] < self.end and (self.check[s + own] < 0).all()), self.end)
            self._room(at_gap + int(own[-1]) + 1)
            self.base[states[first[g]]] = at_gap - low[g]
            self.check[at_gap + own] = states[first[g]]

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children by id; -1 where there is none."""
        slots = self.base[states] + ids
        inside = (slots > 0) & (slots < len(self.check))
        return np.where(inside & (self.check[np.where(inside, slots, 0)] == states), slots, -1)


def dense_ids(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers from 0 of pairs of 64-bit values, equal for equal pairs, counted as they first appear in ``order``."""
    by_value = np.lexsort((values[:, 1], values[:, 0]))
    place = np.empty(len(values), np.int64)
    place[order] = np.arange(len(values))
    new = np.ones(len(values), bool)
    new[1:] = (values[by_value[1:]] != values[by_value[:-1]]).any(axis=1)
    group = np.cumsum(new) - 1
    first = np.full(int(group[-1]) + 1 if len(group) else 0, len(values))
    np.minimum.at(first, group, place[by_value])
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    out = np.empty(len(values), np.int64)
    out[by_value] = rank[group]
    return out


def shard_nodes(rows: pa.Table) -> pa.RecordBatch:
    """The nodes of some whole shards; their rows are ordered by shard, conv_id and depth."""
    conv, depth, split, weight, size = (rows[c].to_numpy() for c in ("conv_id", "depth", "split", "n", "bytes"))
    level = depth - split
    marks, tops, above = (_lanes(rows[c].combine_chunks()) for c in ("mark", "top", "parent"))
    ids = dense_ids(np.where((level == 0)[:, None], tops, marks), np.lexsort((above[:, 1], above[:, 0], level)))
    trie, width = DoubleArray(), int(ids.max()) + 1
    by_level = np.argsort(level, kind="stable")
    levels = np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1)
    state = np.zeros(len(conv), np.int64)
    for number, at in enumerate(levels):
        before = state[at - 1] if number else np.zeros(len(at), np.int64)
        pairs = np.unique(before * width + ids[at])
        trie.add(pairs // width, pairs % width)
        state[at] = trie.step(before, ids[at])
    n = trie.end
    members, least, leaves, saved, row = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(members, state, weight)
    np.minimum.at(least, state, conv)
    row[state] = np.arange(len(conv))
    nodes = [np.unique(state[at]) for at in levels]
    every = np.concatenate(nodes)
    children = np.bincount(trie.check[every], minlength=n)
    leaves[every] = children[every] == 0
    saved[every] = (members[every] - 1) * size[row[every]]
    for at in reversed(nodes[1:]):
        np.add.at(leaves, trie.check[at], leaves[at])
        np.add.at(saved, trie.check[at], saved[at])
    ended = np.full(n, -1)
    last = np.flatnonzero(rows["ends"].is_valid().to_numpy())
    ended[state[last]] = last
    top = level[row[every]] == 0
    return pa.record_batch({
        "conv_id": pa.array(least[every]), "depth": pa.array(depth[row[every]]),
        "parent_conv_id": pa.array(least[trie.check[every]], mask=top),
        "n_convs": pa.array(members[every]), "n_children": pa.array(children[every]), "n_leaves": pa.array(leaves[every]), "saved_tokens": pa.array(saved[every]),
        "ends": rows["ends"].combine_chunks().take(pa.array(ended[every], mask=ended[every] < 0)),
        "parent": rows["parent"].combine_chunks().take(pa.array(row[every], mask=~top)),
    })


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the shards in rows ordered by shard, some whole shards at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows and held and sum(b.num_rows for b in held) >= SHARD_ROWS:
            last, tops = held[-1]["top"][-1], batch["top"]
            cut = next((i for i in range(len(tops)) if tops[i] != last), None)
            if cut is not None:
                yield shard_nodes(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
        if batch.num_rows:
            held.append(batch)
    if held:
        yield shard_nodes(pa.Table.from_batches(held))


def trie_nodes(conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node."""
    tables = Tables(conversations.sparkSession)
    path = rebuilt(conversations, tables).repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    fields = "conv_id long, depth long, mark binary, bytes long, length long"
    chained = tables.keep(path.mapInArrow(_prefix_keys, f"{fields}, key binary, parent binary"))
    ending = chained.where("depth = length").select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    sequences = tables.keep(ending.mapInArrow(_ends, "conv_id long, n long, ends string"))
    rows = tables.keep(chained.join(sequences, "conv_id").withColumn("ends", F.when(F.col("depth") == F.col("length"), F.col("ends"))))

    below = F.sum(F.col("length") - F.col("depth") + 1)
    upper = rows.where("depth > 0").groupBy("key").agg(below.alias("below"), F.max("depth").alias("depth")).where(F.col("below") > shard_rows)
    split = rows.select("conv_id", "key").join(tables.keep(upper.select("key", "depth")), "key").groupBy("conv_id").agg((F.max("depth") + 1).alias("split"))
    placed = tables.keep(rows.join(split, "conv_id", "left").withColumn("split", F.coalesce("split", F.lit(1).cast("long"))))

    tops = placed.where("depth = split").select("conv_id", F.col("key").alias("top"))
    lower = placed.where("depth >= split").join(tops, "conv_id").select("top", "conv_id", "depth", "split", "n", "bytes", "mark", "parent", "ends")
    lower = lower.repartition("top").sortWithinPartitions("top", "conv_id", "depth")
    nodes = tables.keep(lower.mapInArrow(_tries, NODE))

    members = placed.where("depth < split").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("parent").alias("parent"), F.max("ends").alias("ends"))
    shared = tables.keep(members)
    met = nodes.where("parent is not null")
    children = shared.where("parent is not null").select("parent").unionByName(met.select("parent")).groupBy("parent").agg(F.count("*").alias("n_children"))
    counted = shared.join(children.withColumnRenamed("parent", "key"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = counted.select("conv_id", "depth", F.lit(None).cast("binary").alias("key"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    parts = own.unionByName(met.select("conv_id", "depth", F.lit(None).cast("binary").alias("key"), "n_leaves", "saved_tokens"))
    paths = placed.where("depth < split").select("conv_id", "depth", "key", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = paths.unionByName(parts).select("key", *(F.sum(c).over(deeper).alias(c) for c in ("n_leaves", "saved_tokens"))).where("key is not null")
    sums = sums.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    names = shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")]
    first = counted.join(sums, "key").join(names, "parent", "left").withColumn("parent_conv_id", F.col("above")).select(*columns)
    second = met.join(names, "parent", "left").withColumn("parent_conv_id", F.col("above")).select(*columns)
    return first.unionByName(second).unionByName(nodes.where("parent is null").select(*columns))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(load(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH numbered AS (
  SELECT c, mark, bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, mark) AS nth
  FROM (SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS bytes,
          md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS mark
        FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT c, max(nth) AS own FROM numbered GROUP BY c),
crc AS (
  SELECT c, own, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]),
        lambda v, k: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)
      )), 4294967295::BIGINT) AS code
  FROM own),
plan AS (
  SELECT crc.c, crc.c - crc.c % 5 AS base, CASE WHEN crc.c % 5 = 0 THEN 0 ELSE code % 9 END AS skip,
    CASE WHEN crc.c % 5 = 0 THEN 0 ELSE least(code % 9, coalesce(b.own, 0)) END AS head
  FROM crc LEFT JOIN own b ON b.c = crc.c - crc.c % 5),
turns AS (
  SELECT p.c, n.nth - p.skip + p.head AS depth, mark, bytes FROM numbered n JOIN plan p ON n.c = p.c WHERE n.nth > p.skip
  UNION ALL SELECT p.c, n.nth, mark, bytes FROM numbered n JOIN plan p ON n.c = p.base WHERE n.nth <= p.head
  UNION ALL SELECT c, 0, '', 0 FROM plan),
keyed AS (
  SELECT *, string_agg(mark, ',') OVER (PARTITION BY c ORDER BY depth) AS key, max(depth) OVER (PARTITION BY c) AS length FROM turns),
nodes AS (
  SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = length), '')) AS ends_sha256
  FROM keyed GROUP BY key, depth),
placed AS (SELECT n.*, p.key AS parent FROM nodes n LEFT JOIN keyed p ON p.c = n.conv_id AND p.depth = n.depth - 1),
children AS (SELECT parent AS key, count(*) AS n_children FROM placed WHERE depth > 0 GROUP BY parent),
whole AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM placed p LEFT JOIN children USING (key)),
sums AS (
  SELECT k.key, sum((w.n_children = 0)::INT) AS n_leaves, sum((w.n_convs - 1) * w.bytes) AS saved_tokens
  FROM whole w JOIN keyed k ON k.c = w.conv_id AND k.depth <= w.depth GROUP BY k.key)
SELECT w.conv_id, w.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w JOIN sums s USING (key) LEFT JOIN nodes up ON up.key = w.parent
"""
