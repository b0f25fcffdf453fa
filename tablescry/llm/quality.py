"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

The statistics of a text are counts over its whole length, computed in numpy inside
the tasks. The trees are fitted on at most ``SAMPLE_ROWS`` labelled documents, those
whose ids hash lowest; the fit sees only binned statistics. The trees are complete
binary trees stored as flat arrays (feature, threshold, value), and scoring walks all
rows of a batch down one level at a time.

Defined cases: a null or empty text has all statistics 0 and gets a score like any
other; several labels of one document count as the lowest; without labels of both
kinds the score is the share of good ones (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablescry.llm.common import code_points, held_out, lowered, sums_between, text_slices, word_bounds, word_hashes
from tablescry.plans.derived import load

SAMPLE_ROWS = 12_000
ROUNDS, DEPTH, BINS, RATE = 80, 4, 48, 0.15
LEAST_WEIGHT, LEAST_SHARE, RIDGE = 1.0, 0.1, 1.0  # a node has LEAST_WEIGHT of hessian, or that share of all of it on few rows
THRESHOLD = 0.3
_CLASS: dict[str, np.ndarray] = {}
KINDS = ("lower", "upper", "letter", "digit", "space", "newline", "stop", "comma", "exclaim", "bar", "mark", "other", "control")
STATISTICS = (
    "characters", "words", "lines", *(f"share_{k}" for k in KINDS), "word_length", "longest_word", "word_spread", "distinct_words", "repeated_next",
    "repeated_pair", "line_length", "distinct_lines", "words_per_line", "stops_per_word", "bare_words", "short_words", "distinct_characters", "common_word",
)


def _kind_of() -> np.ndarray:
    if not _CLASS:
        table = np.full(0x110000, KINDS.index("other"), np.uint8)
        for c in range(0x30000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = 0 if ch.islower() else 1 if ch.isupper() else 2
            elif ch.isdigit():
                table[c] = 3
        for chars, kind in ((" \t\r\v\f", 4), ("\n", 5), (".", 6), (",;:", 7), ("!?", 8), ("|", 9)):
            table[[ord(x) for x in chars]] = kind
        for c in range(33, 127):
            if table[c] == KINDS.index("other"):
                table[c] = KINDS.index("mark")
        table[[c for c in range(32) if not chr(c).isspace()]] = KINDS.index("control")
        table[0xFFFD] = KINDS.index("control")
        _CLASS["kind"] = table
    return _CLASS["kind"]


def _distinct(number: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts, how many different keys it has and how often its most frequent one occurs."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.sort((number.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24)))
    new = np.ones(len(order), bool)
    new[1:] = order[1:] != order[:-1]
    at = np.flatnonzero(new)
    who = (order[at] >> np.uint64(40)).astype(int)
    most = np.zeros(n)
    np.maximum.at(most, who, np.diff(np.append(at, len(order))))
    return np.bincount(who, minlength=n)[:n].astype(float), most


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n = len(offsets) - 1
    points, bounds = code_points(data, offsets)
    length = np.diff(bounds).astype(float)
    number = np.repeat(np.arange(n), np.diff(bounds))
    kinds = np.bincount(number * len(KINDS) + _kind_of()[points], minlength=n * len(KINDS)).reshape(n, len(KINDS)) if len(points) else np.zeros((n, len(KINDS)))
    starts, ends, word_of = word_bounds(data, offsets)
    sizes = (ends - starts).astype(float)
    words = np.bincount(word_of, minlength=n).astype(float)
    word_at = np.searchsorted(word_of, np.arange(n + 1))
    hashes = word_hashes(lowered(data), starts, ends)
    per = np.maximum(words, 1)
    mean = sums_between(sizes, word_at) / per
    spread = np.sqrt(np.maximum(sums_between(sizes**2, word_at) / per - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, word_of, sizes)
    different, common = _distinct(word_of, hashes, n)
    same, pair = np.zeros(len(hashes)), np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_of[1:] == word_of[:-1])
    pair[2:] = (hashes[2:] == hashes[:-2]) & (word_of[2:] == word_of[:-2])
    bare = sums_between((_letter_byte()[data[ends - 1]]).astype(float), word_at) if len(ends) else np.zeros(n)
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data)) if len(line_start) else line_start
    line_of = np.searchsorted(offsets, line_start, side="right") - 1
    lines = np.bincount(line_of, minlength=n)[:n].astype(float)
    different_lines, _ = _distinct(line_of, word_hashes(data, line_start, line_end), n)
    seen = np.zeros((n, 256), bool)
    seen[number, points & 255] = True
    full = np.maximum(length, 1)[:, None]
    return np.column_stack([
        np.log1p(length), np.log1p(words), np.log1p(lines), kinds / full, mean, longest, spread, different / per ** 0.85, sums_between(same, word_at) / per,
        sums_between(pair, word_at) / per, length / np.maximum(lines, 1), different_lines / np.maximum(lines, 1), words / np.maximum(lines, 1),
        kinds[:, KINDS.index("stop")] / per, bare / per, sums_between((sizes <= 3).astype(float), word_at) / per, seen.sum(axis=1), common / per,
    ])


def _letter_byte() -> np.ndarray:
    table = np.zeros(256, bool)
    table[65:91] = table[97:123] = table[128:] = True
    return table


@dataclass
class Trees:
    """Complete binary trees of equal depth: node k has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(feature) and len(node) and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Gradient boosting of the logistic loss over histograms of quantile bins."""
    inner, leaves, width = 2**depth - 1, 2**depth, x.shape[1]
    share = (y.mean() if len(y) else 0.5).clip(1e-3, 1 - 1e-3) if len(y) else 0.5
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return empty
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)])
    total, features, thresholds, values = np.full(len(y), empty.base), [], [], []
    least = min(LEAST_WEIGHT, LEAST_SHARE * share * (1 - share) * len(y))
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-total))
        gradient, weight = chance - y, np.maximum(chance * (1 - chance), 1e-9)
        node, feature, threshold = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            place = (node - first) * bins
            g_all, w_all = (np.bincount(node - first, v, count) for v in (gradient, weight))
            for j in range(width):
                at = place + binned[:, j]
                g, w = (np.bincount(at, v, count * bins).reshape(count, bins).cumsum(axis=1) for v in (gradient, weight))
                gain = g**2 / (w + RIDGE) + (g_all[:, None] - g) ** 2 / (w_all[:, None] - w + RIDGE) - (g_all**2 / (w_all + RIDGE))[:, None]
                gain[(w < least) | (w_all[:, None] - w < least)] = 0
                gain = gain[:, : len(cuts[j])]
                if not gain.shape[1]:
                    continue
                top = gain.argmax(axis=1)
                better = gain[np.arange(count), top] > best
                best[better] = gain[np.arange(count), top][better]
                feature[first : first + count][better] = j
                threshold[first : first + count][better] = cuts[j][top[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, weight, leaves) + RIDGE)
        total = total + value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), empty.base)


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_slices(batch["text"]):
            rows = text_statistics(data, offsets)
            yield pa.record_batch({
                "doc_id": batch["doc_id"].slice(first, end - first), "quality": batch["quality"].slice(first, end - first),
                "x": pa.array(list(rows), pa.list_(pa.float64())),
            })


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on the labelled documents among ``docs``; at most ``sample_rows`` of them, by hash of the id."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids
    rows = texts.mapInArrow(_statistics_of, "doc_id long, quality int, x array<double>").toArrow().sort_by([("doc_id", "ascending")])
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(STATISTICS))
    return fit_trees(x, rows["quality"].to_numpy().astype(float))


def score_quality(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, keep: list[str] | None = None, only_good: bool = False) -> DataFrame:
    """``keep`` columns of each row with its score and predicted; with only_good the rejected rows are left out
    and no column is added."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # whatever their names
    kept = [f"c{docs.columns.index(c)}" for c in keep]
    source = numbered.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(kept)), F.col(f"c{docs.columns.index('text')}").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.score(text_statistics(data, offsets)) for _, _, data, offsets in text_slices(batch["text"])]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            good = scores >= threshold
            names, own = batch.schema.names[:-1], batch.columns[:-1]
            if only_good:
                yield pa.record_batch(own, names=names).filter(pa.array(good))
            else:
                yield pa.record_batch([*own, pa.array(scores), pa.array(good.astype(np.int32))], names=[*names, "score", "predicted"])

    fields = StructType(source.schema.fields[:-1])
    if only_good:
        return source.mapInArrow(score, fields).toDF(*keep)
    return source.mapInArrow(score, fields.add("score", "double").add("predicted", "integer")).toDF(*keep, "score", "predicted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    trees = train(docs.where(~F.col("held_out")), load(spark, sf_dir, "labels"))
    return score_quality(docs, trees, keep=["doc_id", "held_out"])
