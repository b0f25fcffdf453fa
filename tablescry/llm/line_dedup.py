"""Line deduplication over levelled sorted runs of line keys.

A key is a line stripped of ASCII white space with A-Z lower-cased; runs hold its md5,
in how many documents it stood and the largest doc_id. Documents come in batches. The
keys of a batch are merge-anti-joined with the runs: keys not held yet make a new run on
level 0, the others are written beside it as additions to held keys. A level of
``FAN_OUT`` runs is merged into one sorted run of the next level, so keys stay unique
among the runs and a batch meets only a logarithmic number of them.

A key's documents are then the count in its run plus its additions. Lines of keys found
in enough documents go, except in the largest doc_id that holds the key. Documents that
lose lines get the sorted list of the keys they lose and look their lines up in it by
bisection; texts of the others pass as they are.

All is DataFrame work. Defined cases: null or empty text is one empty line; a null
doc_id is smaller than any other; rows that repeat a doc_id count as documents of their
own and keep or lose lines alike; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescry.plans.derived import load, scratch_folder
from tablescry.session import cut_lineage

LEAST_LENGTH = 20
LEAST_DOCUMENTS = 3
BATCHES = 4
FAN_OUT = 2
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN_SCHEMA = "key string, n long, last long"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def held_keys(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """A row (doc_id, key) for each document and each different long enough key in it, the key as md5."""
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.char_length(k) >= least_length)
    hashed = F.array_distinct(F.transform(keys, lambda k: F.md5(k)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(hashed).alias("key"))


class LineRuns:
    """Levelled runs of line keys in a folder all executors see."""

    def __init__(self, spark: SparkSession, folder: str, fan_out: int = FAN_OUT):
        self.spark, self.folder, self.fan_out = spark, folder, fan_out
        self.levels: list[list[str]] = []
        self.additions: list[str] = []
        self.written = 0

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], RUN_SCHEMA)

    def _path(self) -> str:
        self.written += 1
        return f"{self.folder}/{self.written}"

    def add(self, keys: DataFrame) -> None:
        """Take in a batch of (doc_id, key) rows, one for each document and key."""
        own = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        runs = self._read(sum(self.levels, [])).select("key")
        for held, how in (("fresh", "left_anti"), ("more", "left_semi")):
            path = self._path()
            own.join(runs.hint("merge"), "key", how).sortWithinPartitions("key").write.parquet(path)
            if held == "more":
                self.additions.append(path)
            else:
                self._level(0).append(path)
        self._compact()

    def _level(self, number: int) -> list[str]:
        while len(self.levels) <= number:
            self.levels.append([])
        return self.levels[number]

    def _compact(self) -> None:
        for number in range(len(self.levels)):
            runs = self.levels[number]
            if len(runs) >= self.fan_out:
                path = self._path()
                self._read(runs).repartition("key").sortWithinPartitions("key").write.parquet(path)
                self._level(number + 1).append(path)
                runs.clear()

    def frequent(self, least_documents: int) -> DataFrame:
        """key and last (its largest doc_id) of the keys in at least so many documents."""
        all_rows = reduce(DataFrame.unionByName, [self._read(sum(self.levels, [])), self._read(self.additions)])
        totals = all_rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        return totals.where(F.col("n") >= least_documents).select("key", "last")


def _listed(key: Column, losing: Column) -> Column:
    """Whether a sorted array holds the key: bisection, so long lists of long documents stay cheap."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(losing) + 1)).cast("int"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at.low + at.high) / 2).cast("int")
        right = (at.low < at.high) & (F.get(losing, middle) < key)
        return F.struct(
            F.when(right, middle + 1).otherwise(at.low).alias("low"),
            F.when(right | (at.low >= at.high), at.high).otherwise(middle).alias("high"),
        )

    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(losing).alias("high")), halve, lambda at: F.get(losing, at.low))
    return F.coalesce(found == key, F.lit(False))


def deduplicate_lines(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES
) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of each row of docs."""
    spark = docs.sparkSession
    folder = scratch_folder(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    held_keys(own, least_length).withColumn("batch", batch).write.partitionBy("batch").parquet(f"{folder}/keys")
    keys = spark.read.schema("doc_id long, key string, batch int").parquet(f"{folder}/keys")
    runs = LineRuns(spark, f"{folder}/runs")
    for number in range(batches):
        runs.add(keys.where(F.col("batch") == number).select("doc_id", "key"))
    frequent = cut_lineage(runs.frequent(least_documents))  # behind a plain exchange a hot key's join is split
    gone = keys.join(frequent, "key").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    losing = gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("losing"))
    named = losing.select(F.col("doc_id").alias("_id"), "losing")
    joined = own.join(named, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    lines = lines_of(F.col("text"))
    kept = F.filter(lines, lambda line: ~((F.char_length(line) >= least_length) & _listed(F.md5(line_key(line)), F.col("losing"))))
    judged = joined.select("doc_id", "text", F.when(F.col("losing").isNotNull(), kept).alias("kept"))
    n_lines = F.size(lines).cast("long")
    return judged.select(
        "doc_id", n_lines.alias("n_lines"),
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(n_lines - F.size("kept")).cast("long").alias("n_dropped"),
        F.when(F.col("kept").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("kept", "\n")).alias("kept_text"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicate_lines(load(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.place, k.line, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
