"""Exact quantiles of any number of rows, per key, by mergeable sketches and an exact recount.

One scan builds a KLL sketch per key: its state has a fixed size, combines before the shuffle,
and bounds the value at every rank. A wanted rank therefore lies in a short bracket of values,
a fixed small share of the key's rows. A second scan counts exactly: rows outside the brackets
only add to a count at the bracket's edge, rows inside are counted by value, both before the
shuffle. Running counts over those few values give the wanted ranks. Where the brackets of
a huge key still hold many rows, a scan between the two counts what lies below them and
sketches their inside, which makes them as short again. A sketch that missed its error bound is
found out by the counts, and wider brackets are tried. So keys of any size and distribution
take two scans, three from ``HELD_ROWS`` / ``2 * SLACK`` rows on, and no task holds a group.

Interpolation between neighbouring ranks is linear.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescry.functions.names import columns_of
from tablescry.operators.value_counts import unpivoted
from tablescry.session import cut_lineage

SKETCH = 4096  # the sketch's k: ranks are within 0.071 % in 99 of 100 cases
SLACK = 0.003  # four times that
GRID = 512
HELD_ROWS = 2_000_000
BROADCAST_KEYS = 100_000


def stacked_values(df: DataFrame, columns: dict[str, Column], key: str = "column") -> DataFrame:
    """(key, v) rows for several numeric expressions, nulls dropped."""
    return (
        unpivoted(df, columns, key=key, value="v")
        .where(F.col("v").isNotNull())
    )


def exact_quantiles(pairs: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Rows of ``keys, p, q`` from rows of ``keys, v`` (v a non-null double).

    ``keys`` may be empty, have any names and hold any number of groups of any size; a null
    key is a group.
    """
    keys, probabilities = list(keys), list(probabilities)
    # a struct is never null itself, so null keys meet in joins
    group = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(columns_of(keys)))) if keys else F.struct(F.lit(0).alias("k0"))
    rows = pairs.select(group.alias("k"), pairs["v"].cast("double").alias("v"))
    slack, found = SLACK, None
    while found is None:
        found = _read(rows, probabilities, slack)
        slack *= 8
    out = found.select(*(F.col(f"k.k{i}") for i in range(len(keys))), "p", "q")
    return out.toDF(*keys, "p", "q")


def _read(rows: DataFrame, probabilities: list[float], slack: float) -> DataFrame | None:
    """(k, p, q), or None if a rank was outside its bracket."""
    sketched = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), _sketch(F.col("v")).alias("s"))
    each = range(len(probabilities))
    wanted = sketched.select("k", "n", "lo", "hi", _grid(F.col("s")), *(F.lit(float(p)) * (F.col("n") - 1) for p in probabilities)).toDF("k", "n", "lo", "hi", "grid", *(f"at{i}" for i in each))
    brackets = wanted.select("k", *[c for i in each for c in _bracket(i, F.col("n"), F.col("lo"), F.col("hi"), F.col("grid"), F.lit(0), slack)])
    brackets = cut_lineage(brackets)  # a sketch made again would bound other values
    before = None
    while True:
        size = brackets.agg(F.count("*"), F.max(F.greatest(*(F.col(f"held{i}") for i in each), F.lit(0)))).first()
        if (size[1] or 0) <= HELD_ROWS or (before is not None and size[1] > before / 2):  # or no further gain
            break
        before = size[1]
        narrower = _narrowed(rows, brackets, size[0], len(probabilities), slack)
        if narrower is None:
            return None
        brackets = narrower
    joined = rows.join(_maybe_broadcast(brackets, size[0]), "k")
    inside = F.lit(False)
    edge = F.lit(None).cast("double")
    for i in each:
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        inside = inside | F.col("v").between(low, high)
        edge = F.greatest(edge, F.when(F.col("v") >= low, F.least("v", high)))
    counted = joined.groupBy("k", edge.alias("w"), (~inside).alias("gap")).agg(F.count("*").alias("rows"))
    along = Window.partitionBy("k").orderBy(F.asc_nulls_first("w"), "gap").rowsBetween(Window.unboundedPreceding, 0)
    running = counted.withColumn("through", F.sum("rows").over(along))
    ranked = running.where("not gap").join(_maybe_broadcast(brackets, size[0]), "k")

    def value(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("through") - F.col("rows")) & (rank < F.col("through")), F.col("w")))

    read = ranked.groupBy("k").agg(*[c for i in each for c in (
        value(F.floor(f"at{i}")).alias(f"v{i}"), value(F.ceil(f"at{i}")).alias(f"u{i}"), F.any_value(f"at{i}").alias(f"at{i}"))])
    spread = [F.struct(F.lit(float(p)).alias("p"), (F.col(f"v{i}") + (F.col(f"at{i}") - F.floor(f"at{i}")) * (F.col(f"u{i}") - F.col(f"v{i}"))).alias("q")) for i, p in enumerate(probabilities)]
    result = cut_lineage(read.select("k", F.explode(F.array(*spread)).alias("r")).select("k", "r.p", "r.q"))
    checked = result.agg(F.count("q")).first()[0]
    return result if checked == size[0] * len(probabilities) else None


def _sketch(v: Column) -> Column:
    return F.kll_sketch_agg_double(v, F.lit(SKETCH))


def _grid(sketch: Column) -> Column:
    """The sketch's values at evenly spaced ranks."""
    return F.kll_sketch_get_quantile_double(sketch, F.array(*(F.lit(i / GRID) for i in range(GRID + 1))))


def _bracket(i: int, n: Column, lo: Column, hi: Column, grid: Column, below: Column, slack: float) -> list[Column]:
    """Where the rank ``at`` lies among n sketched rows from lo to hi, ``below`` being smaller: a bracket and about how many rows it holds."""
    at = F.col(f"at{i}")
    first = F.floor(((F.floor(at) - below - 1) / n - slack) * GRID).cast("int")
    last = F.ceil(((F.ceil(at) - below + 2) / n + slack) * GRID).cast("int")
    low = F.when(first <= 0, lo).otherwise(F.get(grid, first))
    high = F.when(last >= GRID, hi).otherwise(F.get(grid, last))
    held = F.when(low == high, 0).otherwise(n * (F.least(last, F.lit(GRID)) - F.greatest(first, F.lit(0))) / GRID)
    return [at.alias(f"at{i}"), low.alias(f"low{i}"), high.alias(f"high{i}"), held.cast("long").alias(f"held{i}")]


def _narrowed(rows: DataFrame, brackets: DataFrame, keys: int, ranks: int, slack: float) -> DataFrame | None:
    """Brackets within the brackets, after counting what lies below them and sketching what lies inside."""
    each = range(ranks)
    inside = [F.col("v").between(F.col(f"low{i}"), F.col(f"high{i}")) for i in each]
    counts = [c for i in each for c in (
        F.count_if(F.col("v") < F.col(f"low{i}")).alias(f"below{i}"), F.count_if(inside[i]).alias(f"n{i}"), _sketch(F.when(inside[i], F.col("v"))).alias(f"s{i}"))]
    joined = rows.join(_maybe_broadcast(brackets, keys), "k")
    found = joined.groupBy("k").agg(*counts).join(_maybe_broadcast(brackets, keys), "k")
    found = found.withColumns({f"grid{i}": _grid(F.col(f"s{i}")) for i in each})
    missed = F.lit(False)
    for i in each:
        missed = missed | (F.floor(f"at{i}") < F.col(f"below{i}")) | (F.ceil(f"at{i}") >= F.col(f"below{i}") + F.col(f"n{i}"))
    named = [c for i in each for c in _bracket(i, *(F.col(f"{c}{i}") for c in ("n", "low", "high", "grid", "below")), slack)]
    out = cut_lineage(found.select("k", *named, missed.alias("missed")))
    return out.drop("missed") if out.where("missed").isEmpty() else None


def _maybe_broadcast(brackets: DataFrame, keys: int) -> DataFrame:
    """A row per key; sent whole only if the keys were counted to be few."""
    return F.broadcast(brackets) if keys <= BROADCAST_KEYS else brackets


# ------------------------------------------------- a bounded set of columns --
def quantile_table(df: DataFrame, columns: dict[str, Column], probabilities: Sequence[float]) -> dict[str, dict[float, float]]:
    """Driver-side quantiles of a few columns: ``{column: {p: q}}``; columns without values are left out."""
    found: dict[str, dict[float, float]] = {}
    if columns:
        for row in exact_quantiles(stacked_values(df, columns), ["column"], probabilities).collect():  # a row per column and probability
            found.setdefault(row["column"], {})[row["p"]] = row["q"]
    return {name: found[name] for name in columns if name in found}


def quantile_rows(df: DataFrame, columns: dict[str, Column], probabilities: Sequence[float], key: str = "measure") -> DataFrame:
    """The same as rows of (key, p, q)."""
    return exact_quantiles(stacked_values(df, columns), ["column"], probabilities).select(F.col("column").alias(key), "p", "q")
