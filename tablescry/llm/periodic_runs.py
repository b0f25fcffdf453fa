"""Runs of periodic words by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q that is at least ``LEAST`` words and
``REPEATS`` periods long and that no neighbouring word extends with that period. The automaton
of a stretch of words has a state for each class of its word sequences; a state's suffix-link
path to the root holds all sequences that end where the state's prefix ends. Words are appended
one after the other: an access to the prefix's state in a link-cut tree over those links makes
its whole path one preferred path, and each segment of earlier preferred paths that it takes
over still has the end where its sequences occurred last. If the distance p from there to the
new end is no longer than the segment's longest sequence, the two occurrences touch or overlap:
a square of period p, which is extended to both sides to its run. Every run is met so, with
its smallest period, because the latest earlier end of a sequence as long as two periods of the
run lies one period back.

Few words can be in a run. With the distance of each word to its previous occurrence, a run
of period q is q words and then a streak of words whose distances are at most q, as all words
of the run recur one period on. Streaks that are long enough for any period between two powers
of two are found for a whole batch of documents in numpy, and only the stretches around them
get an automaton; every run lies in one of them, whole. So memory is bounded by the longest
stretch of a single document, not by the table.

Defined cases: a null or empty text has no words and no runs; rows are judged each, repeated
rows alike; a null doc_id is kept and its words are left as they are; other columns, whatever
their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescry.llm.common import SLICE_BYTES
from tablescry.plans.derived import load

LEAST, REPEATS = 6, 4
RUN = "array<struct<start:long,length:long,period:long>>"
Run = tuple[int, int, int]


class SuffixAutomaton:
    """States of all factors of a word sequence: longest length, suffix link, and the state of each prefix."""

    def __init__(self, words: Sequence[int]):
        length, link, prefixes = [0], [-1], []
        follow: list[dict[int, int]] = [{}]
        last = 0
        for word in words:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            follow.append({})
            prefixes.append(new)
            state = last
            while state >= 0 and word not in follow[state]:
                follow[state][word] = new
                state = link[state]
            if state >= 0:
                target = follow[state][word]
                if length[target] != length[state] + 1:
                    copy = len(length)
                    length.append(length[state] + 1)
                    link.append(link[target])
                    follow.append(follow[target].copy())
                    link[target] = copy
                    while state >= 0 and follow[state].get(word) == target:
                        follow[state][word] = copy
                        state = link[state]
                    target = copy
                link[new] = target
            last = new
        self.length, self.link, self.prefixes = length, link, prefixes


class LastOccurrences:
    """A link-cut tree over suffix links; each preferred path has the end at which its sequences occurred last.

    Node 0 stands for "none" in the splay trees, so states are counted from 1 and the root is state 1.
    All nodes of a splay tree share one end, which is kept at the tree's root.
    """

    def __init__(self, automaton: SuffixAutomaton):
        self.length = [0, *automaton.length]
        self.up = [0, *(parent + 1 for parent in automaton.link)]  # of a splay root: the path's parent state
        self.upper, self.lower = [0] * len(self.up), [0] * len(self.up)
        self.end = [-1] * len(self.up)

    def _splay(self, x: int) -> None:
        up, upper, lower = self.up, self.upper, self.lower
        root, p = x, up[x]
        while p and (upper[p] == root or lower[p] == root):
            root, p = p, up[p]
        end = self.end[root]
        while x != root:
            p = up[x]
            if p == root:
                root = x
            else:
                g = up[p]
                if g == root:
                    root = x
                self._rotate(p if (upper[g] == p) == (upper[p] == x) else x)
            self._rotate(x)
        self.end[x] = end

    def _rotate(self, x: int) -> None:
        up, upper, lower = self.up, self.upper, self.lower
        p = up[x]
        g = up[p]
        if upper[p] == x:
            moved = lower[x]
            upper[p], lower[x] = moved, p
        else:
            moved = upper[x]
            lower[p], upper[x] = moved, p
        if moved:
            up[moved] = p
        up[p], up[x] = x, g
        if g:
            if upper[g] == p:
                upper[g] = x
            elif lower[g] == p:
                lower[g] = x

    def append(self, state: int, end: int) -> list[tuple[int, int]]:
        """Recolour the state's path with ``end``; (earlier end, longest length) of the segments taken over."""
        up, lower, ends = self.up, self.lower, self.end
        met, below, x = [], 0, state + 1
        while x:
            self._splay(x)
            if ends[x] >= 0:
                met.append((ends[x], self.length[x]))
            cut = lower[x]
            if cut:
                ends[cut] = ends[x]
            lower[x] = below
            below, x = x, up[x]
        self._splay(state + 1)
        ends[state + 1] = end
        return met


def stretch_runs(words: Sequence[int], first: int, end: int, least: int = LEAST, repeats: int = REPEATS) -> list[Run]:
    """(start, length, period) of the runs of ``words`` whose squares lie between first and end."""
    automaton = SuffixAutomaton(words[first:end])
    paths = LastOccurrences(automaton)
    reached: dict[int, int] = {}  # by period: where its last stretch ends
    runs = []
    for i, state in enumerate(automaton.prefixes, first):
        for earlier, longest in paths.append(state, i):
            period = i - earlier
            if period > longest or reached.get(period, -1) >= i:
                continue
            start, stop = earlier, i + 1
            while start > 0 and words[start - 1] == words[start - 1 + period]:
                start -= 1
            while stop < len(words) and words[stop] == words[stop - period]:
                stop += 1
            reached[period] = stop - 1
            if stop - start >= max(least, repeats * period):
                runs.append((start, stop - start, period))
    return sorted((s, n, q) for s, n, q in runs)


def likely_stretches(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """(first, end) of the stretches of ids outside of which no run lies, merged and in order; none crosses a bound."""
    order = np.argsort(ids, kind="stable")
    away = np.full(len(ids), np.iinfo(np.int64).max)
    again = np.flatnonzero(ids[order[1:]] == ids[order[:-1]]) + 1
    away[order[again]] = order[again] - order[again - 1]
    found, reach = [], 1
    while max(least - reach, (repeats - 1) * (reach // 2 + 1)) <= len(ids):
        near = np.zeros(len(ids) + 2, np.int8)
        near[1:-1] = away <= reach
        turns = np.flatnonzero(np.diff(near))
        first, end = turns[::2], turns[1::2]
        long = end - first >= max(least - reach, (repeats - 1) * (reach // 2 + 1))
        begins = bounds[np.searchsorted(bounds, first[long], side="right") - 1]
        found.append(np.column_stack([np.maximum(first[long] - reach, begins), end[long]]))
        reach *= 2
    spans = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    to = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] >= to[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(spans)) - 1
    return np.column_stack([spans[new, 0], to[last]])


def folded(words: list[bytes], code: int) -> list[bytes]:
    """Where code ends in 0, words from a place on repeat themselves: a stretch with a period that code and length give."""
    n, g = len(words), code // 10
    if code % 10 or not n:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % period] for k in range(n - a)]


def _of_slice(texts: list[list[bytes]]) -> tuple[list[list[Run]], list[bytes]]:
    """Runs and collapsed text of each list of words."""
    bounds = np.cumsum([0] + [len(w) for w in texts])
    ids = np.zeros(bounds[-1], np.int64)
    fresh, numbers = 0, []
    for words, first, end in zip(texts, bounds[:-1], bounds[1:], strict=True):
        known: dict[bytes, int] = {}
        own = [known.setdefault(w, len(known)) for w in words]
        numbers.append(own)
        ids[first:end] = own
        ids[first:end] += fresh  # no word of one document is a word of another
        fresh += len(known)
    runs: list[list[Run]] = [[] for _ in texts]
    for first, end in likely_stretches(ids, bounds).tolist():
        at = int(np.searchsorted(bounds, first, side="right")) - 1
        runs[at] += stretch_runs(numbers[at], first - int(bounds[at]), end - int(bounds[at]))
    kept = []
    for words, own in zip(texts, runs, strict=True):
        own[:] = sorted(set(own))
        if own:
            drop = np.zeros(len(words) + 1, np.int64)
            for start, length, period in own:
                drop[start + period] += 1
                drop[start + length] -= 1
            words = [w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d]
        kept.append(b" ".join(words))
    return runs, kept


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        first, held, size = 0, [], 0
        for row, (text, code) in enumerate(zip(batch["text"].cast(pa.large_binary()), batch["code"].to_pylist(), strict=True), 1):
            raw = text.as_py() or b""
            words = raw.split()
            held.append(words if code is None else folded(words, code))
            size += len(raw)
            if size >= SLICE_BYTES or row == batch.num_rows:
                runs, kept = _of_slice(held)
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
                yield pa.record_batch({
                    "doc_id": batch["doc_id"].slice(first, row - first), "n_words": pa.array([len(w) for w in held], pa.int64()),
                    "runs": pa.array(rows, kind), "collapsed": pa.array(kept, pa.binary()).cast(pa.string()),
                })
                first, held, size = row, [], 0


def periodic_runs(docs: DataFrame, code: Column | None = None) -> DataFrame:
    """doc_id, n_words, runs and collapsed (the words that no run repeats, joined by spaces) of each row.

    With ``code`` each text's words are folded by it first; a null code leaves them as they are.
    """
    code = F.lit(None) if code is None else code
    source = docs.select("doc_id", "text", code.cast("long").alias("code"))
    return source.mapInArrow(_judge, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUN}, collapsed string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(load(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("brief"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    longest = found.withColumn("best", best)
    return longest.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.brief")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.brief")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
