"""Token ids as directly addressable codes: any token can be read without decoding its block.

An id is cut into bytes, lowest first. Level 0 holds the lowest byte of every id of a
block, level 1 the next byte of those ids that need one, and so on. A bitmap for each
level marks the ids that go on to the next level, and a directory counts the marks
before every 512th place: a token's place on the next level is the directory's count
plus the marks since.

The file is a Parquet table with one row for each block of whole documents, written by
Spark in the order asked for. ``part`` and ``number`` order the blocks, ``before`` counts
the tokens before the block within its part. Only the totals by part are needed for
absolute positions, so no task sees more than one row for each part.

Encoding keeps the ids of frequent pieces: the tokenizer drops white space and joins nothing
across it, so a text's ids are those of its pieces in a row. In texts of Latin letters without
apostrophes and special tokens, which it lower-cases, runs of letters and of other characters
are such pieces too.

Defined cases: null is an empty text, which has the end id alone; null ids come first;
repeated rows are written again, ordered by their texts; an empty table has no blocks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescry.plans.derived import load, scratch_folder

BLOCK_TOKENS = 1 << 18
END_ID = 1
STRIDE = 512
CACHED_PIECES = 400_000
TOKENIZER = "word_bpe_49k.json"
BLOCK_SCHEMA = (
    "part long, number long, before long, n long, doc_ids array<long>, lengths array<long>, levels array<binary>, marks array<binary>, ranks array<binary>"
)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SEPARATED = re.compile(r"[ \n\t\r]+")
_RUNS = re.compile("[a-zªµºß-öø-ÿ]+|[^a-zªµºß-öø-ÿ \n\t\r]+".encode("latin-1"))
_LATIN_LOWER = bytes(ord(chr(c).lower()) for c in range(256))
_KNOWN: dict[str, dict] = {}


def _latin_pieces(text: str) -> list[bytes] | None:
    """Runs of lower-cased letters and of other characters of a plain Latin text; None for any other text."""
    if "'" in text or "<|" in text:
        return None
    try:
        return _RUNS.findall(text.encode("latin-1").translate(_LATIN_LOWER))
    except UnicodeEncodeError:
        return None


class PieceEncoder:
    """Ids of texts, by the tokenizers library, with the ids of frequent pieces at hand."""

    def __init__(self, path: str, known_pieces: int = CACHED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.most = Tokenizer.from_file(path), _KNOWN.setdefault(path, {}), known_pieces

    def _learn(self, pieces: list[str | bytes]) -> None:
        rest = []
        for piece in pieces:
            if isinstance(piece, bytes) and piece.isalpha():  # ASCII: the steps before the merges leave it as it is
                self.known[piece] = np.array([t.id for t in self.tokenizer.model.tokenize(piece.decode())], "<u4").tobytes()
            else:
                rest.append(piece)
        texts = [p.decode("latin-1") if isinstance(p, bytes) else p for p in rest]
        for piece, code in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            self.known[piece] = np.array(code.ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        pieces = _latin_pieces(text or "")
        if pieces is None:
            pieces = _SEPARATED.split(text)
        if len(self.known) > self.most:
            self.known.clear()
        if new := set(pieces).difference(self.known):
            self._learn(list(new))
        return b"".join(map(self.known.__getitem__, pieces))


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, bitmaps and rank directories of unsigned 32-bit ids."""
    levels, marks, ranks, rest = [], [], [], ids.astype(np.uint32)
    while True:
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest >> np.uint32(8)
        more = rest > 0
        if not more.any():
            return levels, marks, ranks
        bits = np.packbits(more, bitorder="little")
        marks.append(bits.tobytes())
        by_stride = np.add.reduceat(_ONES[bits].astype(np.uint32), np.arange(0, len(bits), STRIDE // 8))
        ranks.append((np.cumsum(by_stride, dtype=np.uint32) - by_stride).astype("<u4").tobytes())
        rest = rest[more]


def unpack(levels: list[bytes], marks: list[bytes]) -> np.ndarray:
    """All ids of a block."""
    parts = [np.frombuffer(x, np.uint8).astype(np.uint32) for x in levels]
    for upper, lower, bits in zip(reversed(parts[1:]), reversed(parts[:-1]), reversed(marks), strict=True):
        more = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(lower), bitorder="little").astype(bool)
        lower[more] |= upper << np.uint32(8)
    return parts[0]


def token_at(levels: list[bytes], marks: list[bytes], ranks: list[bytes], place: int) -> int:
    """One id of a block, read through the directories; touches at most STRIDE bits for each level."""
    value = levels[0][place]
    for level, (bits, counts) in enumerate(zip(marks, ranks, strict=True)):
        byte, bit = divmod(place, 8)
        if not bits[byte] >> bit & 1:
            break
        stride = place // STRIDE
        since = bits[stride * STRIDE // 8 : byte]
        place = int.from_bytes(counts[4 * stride : 4 * stride + 4], "little") + int.from_bytes(since, "little").bit_count() + (bits[byte] & (1 << bit) - 1).bit_count()
        value |= levels[level + 1][place] << 8 * (level + 1)
    return value


def _block_writer(path: str, end_id: int, block_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = PieceEncoder(path), TaskContext.get().partitionId()
        end, number, before = np.array([end_id], "<u4").tobytes(), 0, 0
        ids: list[bytes] = []
        docs: list[int | None] = []
        held = 0

        def block() -> pa.RecordBatch:
            lengths = [len(x) // 4 for x in ids]
            levels, marks, ranks = pack(np.frombuffer(b"".join(ids), "<u4"))
            row = {"part": part, "number": number, "before": before, "n": sum(lengths), "doc_ids": docs, "lengths": lengths, "levels": levels, "marks": marks, "ranks": ranks}
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.binary())] * 3
            return pa.record_batch([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                code = encoder.encode(text.as_py()) + end
                ids.append(code)
                docs.append(doc_id)
                held += len(code) // 4
                if held >= block_tokens:
                    yield block()
                    number, before, held = number + 1, before + held, 0
                    ids.clear()
                    docs.clear()
        if ids:
            yield block()

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, order: list[Column] | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the ids of the texts, in this order (ascending doc_id if none is given), each followed by end_id."""
    order = [F.col("doc_id")] if order is None else order  # texts break ties, but never become bounds of ranges
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order, "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered.mapInArrow(_block_writer(tokenizer_path, end_id, block_tokens), BLOCK_SCHEMA).write.parquet(folder)


def part_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, part_start): the number of tokens before each part of a file, a row for each part."""
    parts = spark.read.schema(BLOCK_SCHEMA).parquet(folder).groupBy("part").agg(F.sum("n").alias("part_n"))
    return parts.select("part", (F.sum("part_n").over(_in_order("part")) - F.col("part_n")).alias("part_start"))


def _in_order(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _documents_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, before, docs, lengths, levels, marks in zip(*(batch[c].to_pylist() for c in ("part", "before", "doc_ids", "lengths", "levels", "marks")), strict=True):
            data = unpack(levels, marks).astype("<u4").tobytes()
            ends = np.cumsum(lengths)
            sums = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
            yield pa.record_batch({
                "part": pa.array([part] * len(docs), pa.int64()), "before": pa.array(before + ends - lengths, pa.int64()),
                "doc_id": pa.array(docs, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
            })


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of a file with its place, length and the check sum of its ids."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder).select("part", "before", "doc_ids", "lengths", "levels", "marks")
    found = blocks.mapInArrow(_documents_in, "part long, before long, doc_id long, n_tokens long, ids_crc32 long")
    placed = found.join(part_starts(spark, folder), "part")
    return placed.select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, folder: str, places: list[int]) -> DataFrame:
    """The ids at these places of the whole file: (place, id); places outside have no row."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder).join(part_starts(spark, folder), "part")
    start = F.col("part_start") + F.col("before")
    wanted = F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (p >= start) & (p < start + F.col("n")))
    near = blocks.select(F.explode(wanted).alias("place"), start.alias("start"), "levels", "marks", "ranks")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [token_at(r["levels"], r["marks"], r["ranks"], r["place"] - r["start"]) for r in rows]
            yield pa.record_batch({"place": pa.array([r["place"] for r in rows], pa.int64()), "id": pa.array(found, pa.int64())})

    return near.mapInArrow(pick, "place long, id long")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{scratch_folder(spark)}/tokens"
    write_tokens(load(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return read_documents(spark, folder)
