"""Small helpers the text operators share: numpy work on Arrow text, hashes, held-out marks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescry.plans.derived import scratch_folder

SLICE_BYTES, SLICE_ROWS = 1 << 20, 1 << 14
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
MULTIPLIER = 0x9E3779B97F4A7C15
WORD_MASK = (1 << 64) - 1


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id, as text, leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


class Tables:
    """Written tables in a scratch folder that every executor sees: they cut lineage and can be dropped once spent."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, scratch_folder(spark), {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for frame in frames:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(frame)][0])
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a text column with their bytes and offsets: (first row, end row, bytes, offsets).

    Null is empty. A range ends when it holds ``limit`` bytes or SLICE_ROWS rows; a longer text is a range of its own.
    """
    whole = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(whole):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), first + SLICE_ROWS, len(whole))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finishing steps of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & WORD_MASK, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


class RangeHash:
    """64-bit hashes of ranges of a sequence, equal for equal ranges wherever they stand."""

    def __init__(self, values: np.ndarray, seed: int = 1):
        base = (MULTIPLIER * (2 * seed + 1)) & WORD_MASK | 5
        self.seed = np.uint64(seed)
        self.inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mixed(values.astype(np.uint64) + np.uint64(seed * 0x51ED27)) * powers(base, len(values)), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(MULTIPLIER) + self.seed)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words between ASCII white space."""
    solid = np.ones(256, bool)
    solid[list(SPACE_BYTES)] = False
    inside = solid[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    return RangeHash(data, seed).of(starts, ends)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 text and the offsets of the texts among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    counted = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=counted[1:])
    return points, counted[offsets]


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the ranges that the offsets bound; an empty range gives 0."""
    out = np.zeros(len(offsets) - 1, np.float64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], dtype=np.float64)
    return out
