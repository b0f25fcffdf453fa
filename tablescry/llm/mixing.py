"""Mixing sources to target weights by Pfair scheduling of their blocks.

A source's documents, shuffled by a hash of their ids, are one long text that is cut into
blocks of equal length. Blocks are dealt in rounds: in a full round each source has as many
blocks as its weight, and in the round in which a source ends, what it has left. Block i of
a source with q of the Q blocks of a round is released at slot floor(i * Q / q) and due at
slot ceil((i + 1) * Q / q); each slot takes the released block that is due first. So in any
prefix of a round every source is less than one block off its share, and rounds repeat.

Nothing runs through one task: a source's rows are split by ranges of the hash, block
numbers come from sums within and over the ranges, and rounds with the same blocks share
one schedule. There are at most two different rounds for each source and one more, which
bounds the broadcast schedule by the numbers of sources and of blocks in a round.

Every row stays; the order is the result. All is DataFrame work. Defined cases: a null
source is a source; a null text has the length of an empty one, which is 1 as the end of a
text counts; a document starts in the block that holds its first character; repeated rows
stand side by side; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescry.plans.derived import load

BLOCK_CHARS = 1 << 16
RANGE_ROWS = 20_000
MAX_SOURCES, MAX_ROUND = 1_000, 10_000
TARGET_WEIGHTS = {"src0": 4, "src1": 3, "src2": 2}
OTHER_WEIGHT = 1


def _source_blocks(rows: DataFrame, block_chars: int) -> list[tuple[str | None, int]]:
    """Sources in order, null first, with their numbers of blocks."""
    found = rows.groupBy("_source").agg(F.ceil(F.sum("_size") / block_chars).cast("long").alias("blocks")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to mix")
    return sorted(((r["_source"], r["blocks"]) for r in found), key=lambda x: (x[0] is not None, x[0] or ""))


def _round_kinds(blocks: list[int], weights: list[int]) -> list[tuple[int, int, list[int]]]:
    """Rounds that differ from the one before: (first round, slots before it, blocks of each source in it)."""
    ends = {0} | {n // w for n, w in zip(blocks, weights, strict=True)} | {n // w + 1 for n, w in zip(blocks, weights, strict=True)}
    kinds = []
    for first in sorted(ends):
        shares = [min(w, max(0, n - first * w)) for n, w in zip(blocks, weights, strict=True)]
        if sum(shares):
            kinds.append((first, sum(min(n, first * w) for n, w in zip(blocks, weights, strict=True)), shares))
    return kinds


def _earliest_deadlines(shares: Column, total: Column) -> Column:
    """Array of source numbers, one for each slot of a round: earliest deadline first among the released blocks."""

    def pick(done: Column, slot: Column) -> Column:
        def due(share: Column, k: Column) -> Column:
            had = F.get(done, k)
            released = F.floor(had * total / F.greatest(share, F.lit(1))) <= slot
            return F.when((had < share) & released, F.struct(F.ceil((had + 1) * total / F.greatest(share, F.lit(1))).alias("due"), k.alias("k")))

        return F.array_min(F.filter(F.transform(shares, due), lambda x: x.isNotNull())).k

    def step(state: Column, slot: Column) -> Column:
        k = pick(state.done, slot)
        return F.struct(
            F.transform(state.done, lambda n, i: F.when(i == k, n + 1).otherwise(n)).alias("done"), F.concat(state.picks, F.array(k)).alias("picks")
        )

    start = F.struct(F.transform(shares, lambda _: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("picks"))
    return F.aggregate(F.sequence(F.lit(0), total - 1), start, step, lambda state: state.picks)


def _schedule(spark: SparkSession, kinds: list[tuple[int, int, list[int]]]) -> DataFrame:
    """(_kind, _number, _slots): the slots of each source's blocks in each kind of round."""
    rounds = F.array(*[F.struct(F.lit(first).alias("kind"), F.array(*map(F.lit, shares)).alias("shares")) for first, _, shares in kinds])
    table = spark.range(1).select(F.explode(rounds).alias("r")).select("r.kind", "r.shares")
    total = F.aggregate("shares", F.lit(0), lambda a, x: a + x)
    picks = table.repartition(max(1, len(kinds) // 8), "kind").select("kind", _earliest_deadlines(F.col("shares"), total).alias("picks"))
    slots = picks.select("kind", F.posexplode("picks").alias("slot", "number")).groupBy("kind", "number").agg(F.array_sort(F.collect_list("slot")).alias("_slots"))
    return slots.select(F.col("kind").alias("_kind"), F.col("number").alias("_number"), "_slots")


def mix(
    docs: DataFrame, weights: dict[str | None, int] | None = None, other_weight: int = OTHER_WEIGHT, block_chars: int = BLOCK_CHARS, keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns of each row with _source, _block, _slot and _offset; order by _slot, _offset to read the mixture.

    ``weights`` are whole numbers of blocks in a round, by source.
    """
    weights, keep = weights or {}, ["doc_id"] if keep is None else keep
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col("source").cast("string").alias("_source"), F.col("doc_id").alias("_id"), F.md5(name).alias("_hash"),
        (F.char_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("_size"),
    )
    named = _source_blocks(rows, block_chars)
    each = [max(1, int(weights.get(s, other_weight))) for s, _ in named]
    if sum(each) > MAX_ROUND:
        raise ValueError(f"the weights add up to more than {MAX_ROUND} blocks in a round")
    kinds = _round_kinds([n for _, n in named], each)
    if not kinds:
        empty = F.lit(0).cast("long")
        return rows.select(*keep, "_source", empty.alias("_block"), empty.alias("_slot"), empty.alias("_offset"))
    ranges = max(1, -(-docs.count() // RANGE_ROWS))
    ranged = rows.withColumn("_range", F.floor(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("long"))
    along = Window.partitionBy("_source", "_range").orderBy("_hash", "_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ranged.withColumn("_within", F.sum("_size").over(along) - F.col("_size"))
    sums = ranged.groupBy("_source", "_range").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    placed = counted.join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    offset = (F.col("_before") + F.col("_within")).alias("_offset")
    number = F.coalesce(*[F.when(F.col("_source").eqNullSafe(F.lit(s)), F.lit(k)) for k, (s, _) in enumerate(named)])
    weight = F.get(F.array(*map(F.lit, each)), F.col("_number"))
    blocks = placed.select(*keep, "_source", offset, number.alias("_number")).withColumn("_block", F.floor(F.col("_offset") / block_chars))
    turn = F.floor(F.col("_block") / weight)
    firsts = F.array(*[F.lit(first) for first, _, _ in kinds])
    turned = blocks.withColumn("_turn", turn).withColumn("_kind", F.array_max(F.filter(firsts, lambda f: f <= F.col("_turn"))))
    schedule = _schedule(docs.sparkSession, kinds)
    dealt = turned.join(F.broadcast(schedule), ["_kind", "_number"])  # (2 x sources + 1) x MAX_ROUND numbers at most
    at = F.array_position(firsts, F.col("_kind")).cast("int") - 1
    start = F.get(F.array(*[F.lit(before) for _, before, _ in kinds]), at) + (F.col("_turn") - F.col("_kind")) * F.get(F.array(*[F.lit(sum(s)) for _, _, s in kinds]), at)
    slot = start + F.get("_slots", (F.col("_block") - F.col("_turn") * weight).cast("int"))
    return dealt.select(*keep, "_source", "_block", slot.cast("long").alias("_slot"), "_offset")


def in_mixed_order(docs: DataFrame, weights: dict[str | None, int] | None = None, **options: int) -> DataFrame:
    """All rows and columns of ``docs``, sorted into the mixture."""
    safe = [f"_kept_{i}" for i in range(len(docs.columns))]
    named = [F.col(safe[docs.columns.index(c)]).alias(c) for c in ("doc_id", "source", "text")]
    mixed = mix(docs.toDF(*safe).select("*", *named), weights, keep=safe, **options).orderBy("_slot", "_offset")
    return mixed.select(*safe).toDF(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(load(spark, sf_dir, "documents"), TARGET_WEIGHTS)
    return mixed.select("doc_id", F.col("_source").alias("source"), F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_offset").alias("offset"))


OP3_SQL = """
WITH RECURSIVE
sized AS (SELECT doc_id, source, length(coalesce(text, '')) + 1 AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
placed AS (
  SELECT doc_id, source, (sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS place FROM sized),
sources AS (
  SELECT source, CASE source WHEN 'src0' THEN 4 WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 ELSE 1 END AS w,
    ((sum(size) + 65535) // 65536)::BIGINT AS n FROM sized GROUP BY source),
rounds AS (
  SELECT j, sum(least(w, greatest(0, n - j * w)))::BIGINT AS total, list(least(w, greatest(0, n - j * w))::BIGINT ORDER BY source NULLS FIRST) AS q,
    list(source ORDER BY source NULLS FIRST) AS names, sum(least(n, j * w))::BIGINT AS earlier
  FROM sources, range((SELECT max(n // w) + 1 FROM sources)) r(j) GROUP BY j),
edf AS (
  SELECT j, -1::BIGINT AS t, list_transform(q, lambda x: 0::BIGINT) AS done, -1::BIGINT AS pick FROM rounds
  UNION ALL
  SELECT j, t, list_transform(range(len(done)), lambda i: done[i + 1] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick
  FROM (
    SELECT e.j, e.t + 1 AS t, e.done, list_min(list_filter(list_transform(range(len(e.done)), lambda i:
        CASE WHEN e.done[i + 1] < r.q[i + 1] AND (e.done[i + 1] * r.total) // greatest(r.q[i + 1], 1) <= e.t + 1
             THEN [((e.done[i + 1] + 1) * r.total + r.q[i + 1] - 1) // greatest(r.q[i + 1], 1), i] END), lambda x: x IS NOT NULL))[2] AS pick
    FROM edf e JOIN rounds r ON e.j = r.j WHERE e.t + 1 < r.total)),
slots AS (
  SELECT r.names[e.pick + 1] AS source, e.j, r.earlier + e.t AS slot, e.done[e.pick + 1] - 1 AS i FROM edf e JOIN rounds r ON e.j = r.j WHERE e.t >= 0)
SELECT p.doc_id, p.source, p.place // 65536 AS block, s.slot, p.place AS "offset"
FROM placed p JOIN sources c ON p.source IS NOT DISTINCT FROM c.source
JOIN slots s ON s.source IS NOT DISTINCT FROM p.source AND s.j = (p.place // 65536) // c.w AND s.i = (p.place // 65536) - ((p.place // 65536) // c.w) * c.w
"""
