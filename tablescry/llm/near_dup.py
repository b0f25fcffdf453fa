"""Near-duplicate documents by a signature-coordinate inverted join.

A row's set of word shingles gets a MinHash signature; rows of equal sets are one class,
known by its number in a written table. Classes are posted under their (coordinate, value)
pairs. Two classes whose signatures agree on at least ``matches(percent)`` of ``COORDINATES``
places share one of the COORDINATES - matches + 1 rarest pairs of either, so only those are
posted, and pairs that nobody else has are skipped: most documents leave here. ``matches``
is so low that sets of just the wanted similarity agree on fewer places with a chance below
``MISS``.

Posting lists of large groups of copies are not expanded into all pairs. First each class
meets some hubs of its lists, in rounds that go on while they join many components; links
are confirmed on the full shingle sets. Then only lists that still span several components
are merged, by the same prefix rule on full sets: a list's classes outside its largest
component meet those of other components whose remaining shingles allow enough overlap, and
these pairs are confirmed too. Classes of one component need no further comparison, so no
link between components is lost.

Defined cases: null or empty text has no shingles and no links; every row is judged by its
own text, so rows that share a doc_id but not their text may be in different components, and
rows that repeat both get the same result; a null doc_id is linked like any other but never
names a component unless nothing else is in it (then component_id is null and the row is
kept); very long texts are sets of their own size, one at a time in a task; other columns,
whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescry.llm.common import RangeHash, Tables, lowered, mixed, text_slices, word_bounds, word_hashes
from tablescry.llm.components import components
from tablescry.plans.derived import load

SHINGLE_WORDS = 3
PERCENT = 85
COORDINATES, MISS = 64, 1e-5
HUBS, FEWER = 4, 0.9  # hub rounds go on while they leave fewer than this share of the open components
HASH_BITS = 48
PARITY = 8  # 64-bit words of a set's parity bits


def matches(percent: int) -> int:
    """The most places on which all but MISS of the pairs with this similarity agree, one at least."""
    share, missed = percent / 100, 0.0
    for places in range(COORDINATES + 1):
        missed += comb(COORDINATES, places) * share**places * (1 - share) ** (COORDINATES - places)
        if missed > MISS:
            return max(1, places)
    return COORDINATES


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of each text, one text behind the other, and their bounds."""
    n = len(offsets) - 1
    starts, ends, number = word_bounds(data, offsets)
    first = np.searchsorted(number, np.arange(n + 1))
    count = np.diff(first)
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    of = np.repeat(np.arange(n), shingles)
    begin = np.arange(bounds[-1]) - bounds[of] + first[of]
    hashes = RangeHash(word_hashes(lowered(data), starts, ends)).of(begin, begin + np.minimum(words, count[of]))
    bits = np.uint64(max(1, (n - 1).bit_length()))
    key = np.sort((of.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    bounds = np.searchsorted((key >> (np.uint64(64) - bits)).astype(np.int64), np.arange(n + 1))
    return (key << bits) >> np.uint64(64 - HASH_BITS), bounds


def _signatures(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    turns = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch["text"]):
                hashes, bounds = shingle_sets(data, offsets, words)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                codes = np.zeros((len(sizes), COORDINATES), np.int64)
                prints = [np.zeros(len(sizes), np.uint64) for _ in range(2)]
                if len(full):
                    for k, turn in enumerate(turns):
                        least = np.minimum.reduceat((hashes * turn) >> np.uint64(32), bounds[full])
                        codes[full, k] = least.astype(np.int64) | (k << 32)
                    for k in range(2):
                        prints[k][full] = np.add.reduceat(mixed(hashes + np.uint64(k + 1) * np.uint64(0x632BE59BD9B4E019)), bounds[full])
                yield pa.record_batch({
                    "doc_id": batch["doc_id"].slice(first, end - first), "mark": batch["mark"].slice(first, end - first), "n_shingles": pa.array(sizes, pa.int64()),
                    "f1": pa.array(prints[0].view(np.int64)), "f2": pa.array(prints[1].view(np.int64)),
                    "codes": pa.array([c if s else None for c, s in zip(codes, sizes, strict=True)], pa.list_(pa.int64())),
                })

    return sign


def _full_sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch["text"]):
                hashes, bounds = shingle_sets(data, offsets, words)
                packed = [hashes[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.record_batch({"id": batch["id"].slice(first, end - first), "shingles": pa.array(packed, pa.binary())})

    return sets


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(v.as_buffer(), np.int64) for v in batch["shingles"]]
        sizes = np.array([len(x) for x in sets], int)
        rows = pa.array(np.repeat(np.arange(len(sets)), sizes))
        yield pa.record_batch({
            "id": batch["id"].take(rows), "label": batch["label"].take(rows),
            "n": pa.array(np.repeat(sizes, sizes), pa.int32()), "shingle": pa.array(np.concatenate(sets) if sets else [], pa.int64()),
        })


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's parity bits: bit k says whether an odd number of its shingles has hash k.

    Shared shingles cancel, so two sets' bits differ in no more places than there are
    shingles that only one of them has.
    """
    for batch in batches:
        bits = np.zeros((batch.num_rows, PARITY * 64), np.int64)
        for i, v in enumerate(batch["shingles"]):
            places = mixed(np.frombuffer(v.as_buffer(), np.uint64)) % np.uint64(PARITY * 64)
            bits[i] = np.bincount(places.astype(np.int64), minlength=PARITY * 64)
        packed = np.packbits((bits & 1).astype(np.uint8), axis=1).view(np.int64)
        yield pa.record_batch([batch["id"], *(pa.array(packed[:, k]) for k in range(PARITY))], names=["id", *(f"bits{k}" for k in range(PARITY))])


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (one, other) in enumerate(zip(batch["one"], batch["other"], strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, other))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.record_batch([batch["label_a"], batch["label_b"]], names=["a", "b"]).filter(pa.array(linked))

    return confirm


def _keyed(doc_id: Column, mark: Column) -> list[Column]:
    """A row's doc_id and text mark as columns without nulls, to join on."""
    return [F.coalesce(doc_id, F.lit(0)).alias("k_doc"), doc_id.isNull().alias("k_null"), mark.alias("k_mark")]


KEYS = ["k_doc", "k_null", "k_mark"]


class _Linker:
    """Candidate pairs of classes and the links confirmed so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, percent: int, words: int, tables: Tables):
        self.percent, self.matches, self.tables = percent, matches(percent), tables
        self.codes = classes.select("id", "codes")
        elements = classes.select("id", F.explode("codes").alias("code"))
        counts = tables.keep(elements.groupBy("code").agg(F.count("*").alias("n")).where("n > 1"))  # so that a hot code's join is split
        own = elements.join(counts, "code").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "code"))).alias("held"))  # at most COORDINATES
        early = F.slice("held", 1, F.greatest(F.lit(0), F.size("held") - self.matches + 1))
        posted = own.select("id", F.size("held").alias("shared"), F.explode(early).alias("p"))
        self.posts = tables.keep(posted.select("id", "shared", F.col("p.code").alias("code"), F.col("id").alias("label")))
        tables.drop(counts)
        active = classes.join(self.posts.select("id").distinct(), "id", "left_semi").select("id", *_keyed(F.col("rep.doc_id"), F.col("rep.mark")))
        texts = docs.select("text", *_keyed(F.col("doc_id"), F.col("mark"))).join(active, KEYS)
        once = texts.groupBy(*KEYS, "id").agg(F.any_value("text").alias("text")).select("id", "text")  # where rows repeat
        self.full = tables.keep(once.mapInArrow(_full_sets(words), "id long, shingles binary"))

    def labels(self) -> DataFrame:
        """(id, label): the component each class belongs to by now, if it meets others at all."""
        return self.posts.groupBy("id").agg(F.min("label").alias("label"))

    def _open(self) -> DataFrame:
        """Codes whose lists span several components."""
        return self.posts.groupBy("code").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("code")

    def _matching(self, pairs: DataFrame) -> DataFrame:
        """Pairs with enough equal signature places, and how many."""
        one, other = self.codes.toDF("a", "one"), self.codes.toDF("b", "other")
        same = F.aggregate(F.zip_with("one", "other", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
        return pairs.join(one, "a").join(other, "b").select(*pairs.columns, same.alias("same")).where(F.col("same") >= self.matches)

    def _link(self, pairs: DataFrame) -> None:
        """Join the components of the pairs (a, b, label_a, label_b) that are similar on their full sets."""
        one, other = self.full.toDF("a", "one"), self.full.toDF("b", "other")
        both = pairs.join(one, "a").join(other, "b").select("label_a", "label_b", "one", "other")
        links = self.tables.keep(both.mapInArrow(_confirm(self.percent), "a long, b long"))
        found = components(links, self.tables)
        posts = self.posts.join(found.toDF("label", "next"), "label", "left")
        posts = self.tables.keep(posts.select("id", "shared", "code", F.coalesce("next", "label").alias("label")))
        self.tables.drop(self.posts, links, found)
        self.posts = posts

    def meet_hubs(self) -> None:
        """Link each class to its best match among some hubs of its lists: classes that share most with others."""
        before, number = None, 0
        while True:
            spanning = self.posts.join(self._open(), "code")
            left = spanning.agg(F.count_distinct("label")).first()[0]
            if not left or (before is not None and left > FEWER * before):
                return
            order = F.struct("shared", F.xxhash64("id", F.pmod("code", F.lit(HUBS)), F.lit(number)))
            hubs = self.posts.groupBy("code").agg(F.max_by(F.struct("id", "label"), order).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high"))
            hubs = hubs.where("low <> high").select("code", F.col("hub.id").alias("b"), F.col("hub.label").alias("label_b"))
            pairs = self.posts.join(hubs, "code").where("label <> label_b").select(F.col("id").alias("a"), "b", F.col("label").alias("label_a"), "label_b").distinct()
            best = self._matching(pairs).groupBy("a").agg(F.max_by(F.struct("b", "label_a", "label_b"), F.struct("same", "b")).alias("best"))
            self._link(best.select("a", "best.*"))
            before, number = left, number + 1

    def merge_rest(self) -> None:
        """Confirm every pair that may be similar among the lists that span components still.

        Their classes' shingles are put in order: first those of one component alone, then the
        rarest of the others. Similar sets share a shingle early enough in both for the rest of
        either to hold the overlap that is needed; so a class with too many shingles of its own
        component meets nobody. Of those that meet, pairs whose parity bits differ in too many places
        can't be similar and are not even paired.
        """
        open_ids = self.posts.join(self._open(), "code").groupBy("id").agg(F.min("label").alias("label"))
        sets = self.tables.keep(self.full.join(open_ids, "id").select("id", "label", "shingles"))
        rows = sets.mapInArrow(_shingle_rows, "id long, label long, n int, shingle long")
        counts = rows.groupBy("shingle").agg(F.count("*").alias("times"), F.min("label").alias("low"), F.max("label").alias("high"))
        counts = self.tables.keep(counts.where("low <> high").select("shingle", "times"))
        shared = rows.join(counts, "shingle").groupBy("id").agg(  # at most the shingles of one text
            F.any_value("label").alias("label"), F.any_value("n").alias("n"), F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("held"))
        reach = F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1  # places in which a similar set must meet this one
        first = F.col("n") - F.size("held")
        early = shared.select("id", "label", "n", first.alias("first"), F.posexplode(F.slice("held", 1, F.greatest(F.lit(0), (reach - first).cast("int")))).alias("at", "p"))
        early = early.select("id", "label", "n", (F.col("n") - F.col("first") - F.col("at")).alias("left"), F.col("p.shingle").alias("shingle"))
        bits = [f"bits{k}" for k in range(PARITY)]
        early = self.tables.keep(early.join(sets.mapInArrow(_parities, f"id long, {', '.join(f'{c} long' for c in bits)}"), "id"))
        sizes = early.groupBy("shingle", "label").agg(F.count("*").alias("size"))
        largest = sizes.groupBy("shingle").agg(F.max_by("label", F.struct("size", "label")).alias("most"), F.count("*").alias("labels"))
        largest = self.tables.keep(largest.where("labels > 1").drop("labels"))
        apart, others = (t.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "label", "n", "left", *bits)])
                         for t, side in ((early.join(largest, "shingle").where("label <> most"), "a"), (early, "b")))
        needed = F.ceil((F.col("n_a") + F.col("n_b")) * self.percent / (100 + self.percent))
        differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in bits), F.lit(0))
        similar = (F.least("left_a", "left_b") >= needed) & (differ <= F.col("n_a") + F.col("n_b") - 2 * needed)
        met = apart.join(others, (apart["shingle"] == others["shingle"]) & (F.col("label_a") != F.col("label_b")) & similar)
        ends = F.array_sort(F.array(F.struct(F.col("id_a").alias("id"), F.col("label_a").alias("label")), F.struct(F.col("id_b").alias("id"), F.col("label_b").alias("label"))))
        pairs = met.select(ends.alias("e")).select(*[F.col("e")[i][c].alias(name) for i, c, name in ((0, "id", "a"), (1, "id", "b"), (0, "label", "label_a"), (1, "label", "label_b"))])
        self._link(pairs.distinct())
        self.tables.drop(sets, counts, early, largest)


def _linked(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """doc_id, mark, n_shingles, and the number (label) and least doc_id (named) of the component of each row; without shingles both are null."""
    tables = Tables(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    members = tables.keep(own.mapInArrow(_signatures(words), "doc_id long, mark long, n_shingles long, f1 long, f2 long, codes array<long>"))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    by_set = members.where("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(F.min(row).alias("rep"), F.any_value("codes").alias("codes"))
    classes = tables.keep(by_set.withColumn("id", F.monotonically_increasing_id()))
    linker = _Linker(own, classes, percent, words, tables)
    linker.meet_hubs()
    linker.merge_rest()
    labelled = classes.drop("codes").join(linker.labels(), "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = tables.keep(labelled.groupBy("label").agg(F.min("rep.doc_id").alias("named")))
    labelled = labelled.join(named, "label").select("n_shingles", "f1", "f2", "label", "named")
    return members.drop("codes").join(labelled, ["n_shingles", "f1", "f2"], "left").drop("f1", "f2")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs."""
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("named"))
    judged = _linked(docs, percent, shingle_words).select("doc_id", "n_shingles", component.alias("component_id"))
    return judged.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of ``docs`` for each group: that of its smallest doc_id, or any if it has none.

    Rows without shingles stay; rows that repeat both doc_id and text count once.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    whole = docs.toDF(*names)
    linked = _linked(docs.select("doc_id", "text"), percent, shingle_words).where("label is not null")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    rows = linked.groupBy("label", "doc_id", "mark").agg(F.count("*").alias("n"))
    best = rows.groupBy("label").agg(F.min(row).alias("best"))
    gone = rows.join(best, "label").where(~(row.eqNullSafe(F.col("best")))).select(*_keyed(F.col("doc_id"), F.col("mark")))
    own = [whole[names[docs.columns.index(c)]] for c in ("doc_id", "text")]
    keyed = whole.select("*", *_keyed(own[0].cast("long"), F.xxhash64(own[1])))
    once = keyed.withColumn("nth", F.row_number().over(Window.partitionBy(*KEYS).orderBy("k_mark"))).where("nth = 1")
    return once.join(gone, KEYS, "left_anti").select(*names).toDF(*docs.columns)


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
