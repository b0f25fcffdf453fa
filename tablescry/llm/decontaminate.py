"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words, lower-cased and stripped of ASCII marks, go into one automaton whose
states stand for the word sequences found in items. Each document's words are streamed
through it; the state always knows the longest stretch of words, ending here, that some
item holds. Where that is a window or more, the window's words are hit.

The automaton of at most ``PASS_WORDS`` item words is built in the tasks; a larger
benchmark takes several passes over the documents, each keeping the earlier hits, so
neither a broadcast nor a task's memory grows with the benchmark.

Defined cases: a null or empty text has no words and no hits; items without id or words
take no part; items of fewer words than a window count as one window; repeated rows of
documents are judged each, repeated items once; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescry.plans.derived import load
from tablescry.session import cut_lineage

WINDOW = 13
PASS_WORDS = 200_000
PIECE_WORDS = 2_000
LEAST_SHARE = 20  # a document is contaminated when at least one word in so many is hit
#: Letters, digits and everything beyond ASCII make words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_BUILT: dict[str, "ItemAutomaton"] = {}


def plain_words(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, pieces: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.words = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [(item, [self.words.setdefault(w, len(self.words)) for w in words]) for item, words in pieces if words]
        for _, sequence in numbered:
            last = 0
            for w in sequence:
                last = self._extended(last, w)
        self.items: dict[int, set[str]] = {}  # by the state of a full window
        self.short: dict[int, dict[int, set[str]]] = {}  # by the state and length of a short item
        for item, sequence in numbered:
            state = 0
            for w in sequence[: window - 1]:
                state = self.next[state][w]
            if len(sequence) < window:
                self.short.setdefault(state, {}).setdefault(len(sequence), set()).add(item)
            for w in sequence[window - 1 :]:
                state = self.next[state][w]
                self.items.setdefault(self._window_state(state), set()).add(item)
        self.least = min([window, *(n for lengths in self.short.values() for n in lengths)])

    def _extended(self, last: int, w: int) -> int:
        """The state of the sequence so far and w behind it."""
        if w in self.next[last]:
            there = self.next[last][w]
            return there if self.length[there] == self.length[last] + 1 else self._split(last, w, there)
        new = self._state(self.length[last] + 1, {})
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = new
            last = self.link[last]
        if last < 0:
            self.link[new] = 0
            return new
        there = self.next[last][w]
        self.link[new] = there if self.length[there] == self.length[last] + 1 else self._split(last, w, there)
        return new

    def _split(self, last: int, w: int, there: int) -> int:
        """Part the shorter sequences of a state from it."""
        copy = self._state(self.length[last] + 1, dict(self.next[there]))
        self.link[copy], self.link[there] = self.link[there], copy
        while last >= 0 and self.next[last].get(w) == there:
            self.next[last][w] = copy
            last = self.link[last]
        return copy

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges (start, end) that are hit, merged, and the items found."""
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]])))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - first >= self.least:  # no window fits in a shorter stretch of item words
                self._stream(ids[first:end].tolist(), first, spans, found)
        return merged(spans), found

    def _stream(self, ids: list[int], first: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        state = length = 0
        for place, w in enumerate(ids, first + 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w not in self.next[state]:
                continue
            state, length = self.next[state][w], length + 1
            if length >= self.window:
                spans.append((place - self.window, place))
                found |= self.items.get(self._window_state(state), set())
            at = state if self.short else -1
            while at > 0:
                for n, items in self.short.get(at, {}).items():
                    if n <= length:
                        spans.append((place - n, place))
                        found |= items
                at = self.link[at]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _pieces(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items cut into pieces that overlap so far that no window is lost."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                words = plain_words(text.as_py())
                starts = range(0, max(1, len(words) - window + 1), PIECE_WORDS) if words else ()
                parts = [words[s : s + PIECE_WORDS + window - 1] for s in starts]
                yield pa.record_batch({
                    "item_id": pa.array([item] * len(parts), pa.string()), "words": pa.array([b" ".join(p) for p in parts], pa.binary()),
                    "n": pa.array([len(p) for p in parts], pa.int64()),
                })

    return cut


def _matcher(shared: Broadcast, window: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    own = uuid.uuid4().hex

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if own not in _BUILT:  # built once in a worker, which holds one at a time
            _BUILT.clear()
            _BUILT[own] = ItemAutomaton(((item, words.split()) for item, words in shared.value), window)
        automaton = _BUILT[own]
        for batch in batches:
            counts, spans, items = [], [], []
            for text, old_spans, old_items in zip(batch["_text"].cast(pa.large_binary()), batch["_spans"].to_pylist(), batch["_items"].to_pylist(), strict=True):
                words = plain_words(text.as_py())
                hit, found = automaton.matches(words)
                counts.append(len(words))
                spans.append([x for span in merged(hit + list(zip(old_spans[::2], old_spans[1::2], strict=True))) for x in span])
                items.append(sorted(found.union(old_items)))
            made = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.record_batch([*(batch[n] for n in names), batch["_text"], *made], names=[*names, "_text", "_words", "_spans", "_items"])

    return match


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: list[str] | None = None, pass_words: int = PASS_WORDS) -> DataFrame:
    """``keep`` columns of each row with _text, _words (how many), _spans (starts and ends of hit word ranges, flat) and _items."""
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    usable = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    pieces = usable.mapInArrow(_pieces(window), "item_id string, words binary, n long").distinct()
    passes = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // pass_words))
    empty = F.array().cast("array<long>"), F.array().cast("array<string>")
    found = docs.select(*keep, F.col("text").alias("_text"), F.lit(0).cast("long").alias("_words"), empty[0].alias("_spans"), empty[1].alias("_items"))
    for number in range(passes):
        rows = pieces.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(passes)) == number).select("item_id", "words").toArrow()
        shared = spark.sparkContext.broadcast(list(zip(rows["item_id"].to_pylist(), rows["words"].to_pylist(), strict=True)))  # about pass_words words
        found = found.mapInArrow(_matcher(shared, window, keep), found.schema)
        if number + 1 < passes:
            found = cut_lineage(found)
    return found


def hits() -> Column:
    """How many words the flat _spans cover."""
    return F.aggregate(F.sequence(F.lit(0), F.size("_spans") - 1), F.lit(0).cast("long"), lambda n, i: n + F.when(i % 2 == 1, 1).otherwise(-1) * F.get("_spans", i))


def with_verdict(found: DataFrame, least_share: int = LEAST_SHARE) -> DataFrame:
    """n_words, n_hit and contaminated instead of the words and spans."""
    counted = found.withColumn("n_hit", F.when(F.size("_spans") > 0, hits()).otherwise(F.lit(0).cast("long"))).withColumnRenamed("_words", "n_words")
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * least_share >= F.col("n_words")))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_share: int = LEAST_SHARE) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    safe = [f"_kept_{i}" for i in range(len(docs.columns))]  # free of clashes with the columns made here
    text = safe[docs.columns.index("text")]
    judged = with_verdict(find_items(docs.toDF(*safe).withColumnRenamed(text, "text"), items, window, [c for c in safe if c != text]), least_share)
    return judged.where(~F.col("contaminated")).withColumnRenamed("_text", text).select(*safe).toDF(*docs.columns)


def without_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_words: int = WINDOW) -> DataFrame:
    """doc_id and text of each row with the hit stretches of at least least_words words cut out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch["_text"].cast(pa.large_binary()), batch["_spans"].to_pylist(), strict=True):
                raw = text.as_py()
                ranges = [(s, e) for s, e in zip(spans[::2], spans[1::2], strict=True) if e - s >= least_words]
                if raw and ranges:
                    at = [m.span() for m in _WORD.finditer(raw.translate(_PLAIN))]
                    for start, end in reversed(ranges):
                        raw = raw[: at[start][0]] + raw[at[end - 1][1] :]
                texts.append(raw.decode("utf-8", "ignore") if raw is not None else None)
            yield pa.record_batch({"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string())})

    found = find_items(docs, items, window)
    return found.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")



def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = with_verdict(find_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"), "contaminated",
    )
