"""Removal of long repeated word sequences by De Bruijn compaction.

Every window of ``WINDOW`` words is an edge of a De Bruijn graph of word sequences. Edges
are not shuffled one by one: consecutive windows of a document with the same least
``ANCHOR``-word sequence (equal windows have it at the same place) form a path, and paths
meet under that anchor. Where all paths of an anchor are equal, the graph does not branch
and the path is compacted: it repeats as a whole if it occurs twice. Only at branching
anchors are paths taken apart: one copy of each different path is cut into its edges, and
these are counted with how often their paths occur. Joins then bring the repeated paths
and edges back to their source coordinates (document, first word, number of windows),
which are merged and cut out of the texts.

Paths are compared by 64-bit hashes within an anchor, whose own 64-bit hash they share.

Defined cases: a null or empty text has no words; rows with the same doc_id are documents
of their own (a repeated row repeats all its windows); a null doc_id is handled like any
other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescry.llm.common import RangeHash, text_slices, word_bounds, word_hashes
from tablescry.plans.derived import load
from tablescry.session import cut_lineage

WINDOW = 35
ANCHOR = 8
LENGTH_BITS = 16  # of a path's number of windows, which is below WINDOW


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in each range of ``width`` values."""
    best, size = np.arange(len(values)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while size * 2 <= width:
        best = better(best[:-size], best[size:])
        size *= 2
    rest = width - size
    return better(best[: len(best) - rest], best[rest:]) if rest else best


def _hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[RangeHash, np.ndarray, np.ndarray]:
    """Range hashes over the words of all texts, and each text's first word and number of words."""
    starts, ends, number = word_bounds(data, offsets)
    first = np.searchsorted(number, np.arange(len(offsets)))
    return RangeHash(word_hashes(data, starts, ends), 2), first[:-1], np.diff(first)


def _paths(window: int, anchor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in text_slices(batch["text"]):
                words, first, count = _hashed_words(data, offsets)
                total = int(count.sum())
                if total < window:
                    continue
                begin = np.arange(total - anchor + 1)
                anchors = words.of(begin, begin + anchor)
                at = least_places(anchors, window - anchor + 1)  # one for each window of the slice
                text = np.repeat(np.arange(len(count)), count)[: len(at)]
                inside = np.arange(len(at)) + window <= (first + count)[text]
                new = inside.copy()  # a path starts where the anchor's place or the text changes
                new[1:] &= (at[1:] != at[:-1]) | (text[1:] != text[:-1])
                start = np.flatnonzero(new)
                length = np.diff(np.append(np.cumsum(inside)[start] - 1, inside.sum()))
                place = ((start - first[text[start]]) << LENGTH_BITS) | length
                rows = pa.array(row + text[start])
                yield pa.record_batch({
                    "doc_id": batch["doc_id"].take(rows), "rid": batch["rid"].take(rows), "place": pa.array(place, pa.int64()),
                    "anchor": pa.array(anchors[at[start]].view(np.int64)), "path": pa.array(words.of(start, start + length + window - 1).view(np.int64)),
                })

    return paths


def _edges(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch["asked"]
            for row, end, data, offsets in text_slices(batch["text"]):
                words, first, _ = _hashed_words(data, offsets)
                own = asked.slice(row, end - row)
                lists = np.repeat(np.arange(end - row), np.diff(own.offsets.to_numpy()))
                parts = own.flatten()
                place = parts.field("place").to_numpy()
                length = place & ((1 << LENGTH_BITS) - 1)
                of = np.repeat(np.arange(len(place)), length)
                step = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
                at = (place >> LENGTH_BITS)[of] + step
                begin = first[lists[of]] + at
                rows = pa.array(row + lists[of])
                yield pa.record_batch({
                    "doc_id": batch["doc_id"].take(rows), "rid": batch["rid"].take(rows), "place": pa.array((at << LENGTH_BITS) | 1, pa.int64()),
                    "anchor": parts.field("anchor").take(pa.array(of)), "weight": parts.field("weight").take(pa.array(of)),
                    "edge": pa.array(words.of(begin, begin + window).view(np.int64)),
                })

    return edges


def _cut(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, places in zip(batch["text"].cast(pa.large_binary()), batch["places"], strict=True):
                words = (text.as_py() or b"").split()
                n_words.append(len(words))
                if places.is_valid:
                    place = places.values.to_numpy()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, place >> LENGTH_BITS, 1)
                    np.add.at(edge, (place >> LENGTH_BITS) + (place & ((1 << LENGTH_BITS) - 1)) + window - 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch({
                "doc_id": batch["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            })

    return cut


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return (left["rid"] == right["rid"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def repeated_places(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, rid, place) of the repeated paths and edges of ``docs`` (doc_id, text, rid);
    place is the first word << LENGTH_BITS | the number of windows."""
    paths = docs.mapInArrow(_paths(window, anchor), "doc_id long, rid long, place long, anchor long, path long")
    shape = paths.groupBy("anchor").agg(F.count("*").alias("n"), F.min("path").alias("low"), F.max("path").alias("high")).where("n > 1")
    shape = cut_lineage(shape.select("anchor", F.expr("low <> high").alias("branching")))  # behind a plain exchange a hot anchor's join is split
    held = cut_lineage(paths.join(shape, "anchor"))
    compact = held.where("not branching").select("doc_id", "rid", "place")
    branches = held.where("branching")
    kinds = branches.groupBy("anchor", "path").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rid", "place")).alias("at"))
    kinds = cut_lineage(kinds)
    twice = branches.join(kinds.where("n > 1").select("anchor", "path"), ["anchor", "path"]).select("doc_id", "rid", "place")
    asked = kinds.select("at.doc_id", "at.rid", F.struct("anchor", "at.place", F.least("n", F.lit(2)).alias("weight")).alias("part"))
    asked = asked.groupBy("doc_id", "rid").agg(F.collect_list("part").alias("asked"))  # parts of one text
    texts = docs.join(asked, _same_row(docs, asked)).select(docs["doc_id"], "text", docs["rid"], "asked")
    edges = texts.mapInArrow(_edges(window), "doc_id long, rid long, place long, anchor long, weight long, edge long")
    often = edges.groupBy("anchor", "edge").agg(F.sum("weight").alias("n")).where("n > 1").select("anchor", "edge")
    single = edges.where("weight = 1").join(often, ["anchor", "edge"]).select("doc_id", "rid", "place")
    return compact.union(twice).union(single)


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of each row of docs."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rid", F.xxhash64("doc_id", "text"))
    places = repeated_places(own, window, anchor).groupBy("doc_id", "rid").agg(F.collect_list("place").alias("places"))
    joined = own.join(places, _same_row(own, places), "left").select(own["doc_id"], "text", "places")
    return joined.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(load(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
