"""Secret scans over every historical version of a set of texts, by an incremental blob ledger.

A version's text is addressed by its SHA-256, so copies, renames and unchanged versions are one
blob. The ledger is a written table of (blob, rules, found): which versions of which rules a
blob was scanned with, and what they found. A scan first subtracts what the ledger holds from
the pairs of blob and rule version that the paths need, so only unseen pairs are scanned: a new
rule runs over old blobs alone, and a new path to an old blob costs a join. One text of each
unseen blob is shuffled, copies being folded before; findings are joined back to all paths.

Defined cases: a null text is an empty one; a null path is kept like any other; repeated rows of
a path get their findings each; a very long text is one row that is scanned alone; other columns,
whatever their names, are not looked at; an empty table gives an empty result and an empty run.
Spans count code points, ends exclusive; several kinds may overlap, matches of one kind do not.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescry.plans.derived import load, scratch_folder


@dataclass(frozen=True)
class Rule:
    """Bytes of a kind of secret: the leftmost matches whose group is long enough. All patterns are ASCII."""

    kind: str
    pattern: bytes
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:16]}"

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        found = re.compile(self.pattern).finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


#: What a secret looks like. The lengths of the base rules are in their counts where that finds the same matches.
BASE_RULES = (
    Rule("assign", rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", rb"AKIA[A-Z0-9]{16,}"),
    Rule("hex", rb"[0-9a-f]{24,}"),
)
FURTHER_RULES = (
    Rule("private_key", rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[^-]{16,}(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?"),
    Rule("web_token", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hosted_token", rb"gh[oprsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_password", rb"://[^\s/:@'\"<>]{1,64}:([^\s/:@'\"<>]+)@", 1, 3),
)
RULES = BASE_RULES + FURTHER_RULES
FOUND = "array<struct<kind:string,start:long,end:long>>"


def scan_text(text: bytes, rules: tuple[Rule, ...]) -> list[dict]:
    """Findings of the rules in one text, by start and then by the order of the rules."""
    spans = [(start, place, rule.kind, end) for place, rule in enumerate(rules) for start, end in rule.spans(text)]
    if not spans:
        return []
    counted = None if text.isascii() else np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    at = int if counted is None else lambda i: int(counted[i])
    return [{"kind": kind, "start": at(start), "end": at(end)} for start, _, kind, end in sorted(spans)]


def _scan(rules: tuple[Rule, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    known = {rule.version: rule for rule in rules}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary())
            found = [scan_text(text.as_py() or b"", tuple(known[v] for v in wanted.as_py())) for text, wanted in zip(texts, batch["rules"], strict=True)]
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch({"blob": batch["blob"], "rules": batch["rules"], "found": pa.array(found, kinds)})

    return scan


def address(text: Column) -> Column:
    """The blob that a text is."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class BlobLedger:
    """Blobs, the rule versions they were scanned with, and what was found, in a folder of runs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _runs(self) -> list[str]:
        """Finished runs; one that was cut off has no success mark and is not read."""
        files = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/run-*/_SUCCESS")
        found = files.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(files) or []
        return sorted(status.getPath().getParent().toString() for status in found)

    def entries(self) -> DataFrame:
        """(blob, rules, found), one row for each scan of a blob."""
        runs = self._runs()
        schema = f"blob binary, rules array<string>, found {FOUND}"
        return self.spark.read.schema(schema).parquet(*runs) if runs else self.spark.createDataFrame([], schema)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the unseen pairs of the blobs of ``versions`` (a column text) and of rule versions."""
        wanted = F.array(*(F.lit(rule.version) for rule in rules))
        texts = versions.select(address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        unseen = texts.groupBy("blob").agg(F.any_value("text").alias("text")).withColumn("rules", wanted)
        if self._runs():
            seen = self.entries().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
            unseen = unseen.join(seen, "blob", "left").withColumn("rules", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        unseen = unseen.where(F.size("rules") > 0).select("blob", "text", "rules")
        found = unseen.mapInArrow(_scan(rules), f"blob binary, rules array<string>, found {FOUND}")
        found.write.parquet(f"{self.folder}/run-{len(self._runs()):05}-{uuid.uuid4().hex}")

    def findings(self, paths: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Each row of ``paths`` (a column blob) with ``found``: all findings of these kinds, by start and order of the rules."""
        kinds = [rule.kind for rule in rules]
        versions = F.array(*(F.lit(rule.version) for rule in rules))
        place = F.array(*(F.lit(kind) for kind in kinds))
        held = self.entries().where((F.size("found") > 0) & F.arrays_overlap("rules", versions))
        fresh = F.filter("found", lambda x: F.array_contains(F.transform(F.array_intersect("rules", versions), lambda v: F.substring_index(v, "@", 1)), x["kind"]))
        whole = held.select("blob", fresh.alias("found")).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
        keyed = F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.array_position(place, x["kind"]).alias("place"), x["end"].alias("end")))
        named = F.transform(F.array_sort(keyed), lambda x: F.struct(F.element_at(place, x["place"].cast("int")).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        assert len(kinds) == len(set(kinds)), "one rule for each kind"
        return paths.join(whole.select("blob", named.alias("found")), "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(FOUND)))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, ledger: BlobLedger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``found`` of each row of docs, every row being a path to its text's blob."""
    ledger.scan(docs.select("text"), rules)
    return ledger.findings(docs.select("doc_id", address(F.col("text")).alias("blob")), rules).select("doc_id", "found")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(load(spark, sf_dir, "documents"), BlobLedger(spark, scratch_folder(spark)))
    return digests(found)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the numbers of the base kinds, and all spans in words."""
    kinds = [rule.kind for rule in BASE_RULES]
    base = F.filter("found", lambda x: x["kind"].isin(kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
