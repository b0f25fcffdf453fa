"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting: each task adds up the n-gram buckets of its texts by language and Spark
sums the sparse counts by (language, bucket). The model is a matrix of languages x
buckets, whose size does not depend on the corpus; it is collected, turned into
log-probabilities, broadcast, and every whole text is scored in numpy.

Letters are lower-cased and every run of other characters counts as one space, so
digits and marks carry nothing. Defined cases: null text or text without letters is
``und`` with score 0; ties go to the language that sorts first; without any training
text all is ``und``; repeated rows are scored like any other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescry.llm.common import code_points, held_out, sums_between, text_slices
from tablescry.plans.derived import load
from tablescry.session import cut_lineage

ORDERS = (1, 2, 3)
BUCKET_BITS = 15
MAX_MODEL_CELLS = 1 << 25
UNDETERMINED = "und"
_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space where it is no letter."""
    if "letters" not in _TABLES:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x33000):  # no letters above
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLES["letters"] = table
    return _TABLES["letters"]


def gram_buckets(points: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, one row for each order, bounds of the texts in a row, and which have letters."""
    text = _letters()[points]
    number = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    space = text == 32
    first = np.zeros(len(text), bool)
    first[offsets[:-1][offsets[:-1] < len(text)]] = True
    keep = ~space | first
    keep[1:] |= ~space[:-1]
    text, number = text[keep], number[keep]
    bounds = np.searchsorted(number, np.arange(len(offsets)))
    lettered = sums_between((text != 32).astype(np.float32), bounds) > 0
    rows, shift = [], np.uint32(32 - bits)
    code = np.zeros(len(text), np.uint32)
    for n in ORDERS:
        late = np.full(len(text), 32, np.uint32)  # behind the end of a text stands a space
        late[: len(text) - (n - 1)] = text[n - 1 :]
        if n > 1 and len(text):
            late[: len(text) - (n - 1)][number[n - 1 :] != number[: len(text) - (n - 1)]] = 32
        code = code * np.uint32(0x9E3779B1) + late + np.uint32(n)
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        rows.append((mixed >> shift).astype(np.int32))
    return np.stack(rows), bounds, lettered


def _counter(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << bits, np.int64))
        documents: dict[str, int] = defaultdict(int)
        for batch in batches:
            langs = np.asarray(batch["lang"].to_pylist(), dtype=object)
            for first, end, data, offsets in text_slices(batch["text"]):
                buckets, bounds, _ = gram_buckets(*code_points(data, offsets), bits)
                for lang in dict.fromkeys(langs[first:end]):
                    own = np.flatnonzero(langs[first:end] == lang)
                    documents[lang] += len(own)
                    chosen = np.zeros(bounds[-1], bool)
                    for i in own:
                        chosen[bounds[i] : bounds[i + 1]] = True
                    totals[lang] += np.bincount(buckets[:, chosen].ravel(), minlength=1 << bits)
        for lang, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.record_batch({  # bucket -1 holds the number of documents
                "lang": pa.array([lang] * (len(used) + 1)),
                "bucket": pa.array(np.append(used, -1), pa.int32()),
                "n": pa.array(np.append(counts[used], documents[lang]), pa.int64()),
            })

    return count


def train(docs: DataFrame, bits: int = BUCKET_BITS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (languages x buckets) and log-priors from all rows with text and lang."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    summed = cut_lineage(known.mapInArrow(_counter(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    found = summed.groupBy("lang").agg(F.max("bucket")).count()
    if found << bits > MAX_MODEL_CELLS:
        raise ValueError(f"{found} languages x {1 << bits} buckets is more than the broadcast model may hold")
    rows = summed.toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    place = {lang: i for i, lang in enumerate(langs)}
    counts, documents = np.zeros((len(langs), 1 << bits)), np.zeros(len(langs))
    who = np.array([place[x] for x in rows["lang"].to_pylist()], int)
    bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    counts[who[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    documents[who[bucket < 0]] = n[bucket < 0]
    chances = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * (1 << bits)))
    return langs, chances.astype(np.float32), np.log((documents + 1) / (documents.sum() + len(langs)))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: dict[str, Column] | None = None) -> DataFrame:
    """lang_pred and score of each whole text, with the ``keep`` columns (simple types) beside them."""
    keep = {"doc_id": F.col("doc_id")} if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[c.alias(n) for n, c in keep.items()], F.col("text").alias("_text"))
    names = list(keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, chances, priors = shared.value
        bits = int(chances.shape[1]).bit_length() - 1
        for batch in batches:
            predicted: list[str] = []
            scores: list[np.ndarray] = []
            for _, _, data, offsets in text_slices(batch["_text"]):
                buckets, bounds, lettered = gram_buckets(*code_points(data, offsets), bits)
                if not langs:
                    predicted += [UNDETERMINED] * len(lettered)
                    scores.append(np.zeros(len(lettered)))
                    continue
                likely = np.stack([sum(sums_between(row[b], bounds) for b in buckets) for row in chances]) + priors[:, None]
                best = likely.argmax(axis=0)
                share = 1 / np.exp(likely - likely.max(axis=0)).sum(axis=0)
                predicted += [langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
                scores.append(np.where(lettered, share, 0.0))
            yield pa.record_batch(
                [batch[n] for n in names] + [pa.array(predicted, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                names=[*names, "lang_pred", "score"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(score, f"{fields}{', ' if fields else ''}lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = held_out(F.col("doc_id"), 3, 1)
    return identify(docs, train(docs.where(~apart)), {"doc_id": F.col("doc_id"), "held_out": apart})
