"""Reading delimited text the way a spreadsheet export needs it."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescry.functions.names import NotCalculable
from tablescry.functions.scalars import NUMBER_SHAPE, is_text_type, present, strip_ws

# Cells that mean missing in a delimited file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_WORDS, FALSE_WORDS = ("true",), ("false",)
WHOLE_NUMBER = r"^[+-]?[0-9]+$"


class EmptyTable(NotCalculable):
    """The file has no rows or no columns."""


def repaired_header(names: list[str | None]) -> list[str]:
    """Blank names become ``Unnamed: i``; repeats get ``.1``, ``.2`` ..."""
    plain = [n if n is not None and n.strip() else f"Unnamed: {i}" for i, n in enumerate(names)]
    seen: Counter[str] = Counter()
    result: list[str] = []
    for name in plain:
        candidate = name
        while candidate in result:
            seen[name] += 1
            candidate = f"{name}.{seen[name]}"
        result.append(candidate)
    return result


def _read(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool, encoding: str) -> DataFrame:
    return spark.read.csv(
        path, schema=schema, header=True, multiLine=multi_line, escape='"', encoding=encoding, enforceSchema=True
    )


def _utf8(cell: Column) -> Column:
    """The bytes of a cell that was read as Latin-1, as UTF-8."""
    return F.encode(cell, "ISO-8859-1").cast("string")


def _has_broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether a line holds an odd number of quotes, so a cell goes on in the next line."""
    return not spark.read.text(path).where(_quotes(F.col("value")) % 2 == 1).isEmpty()


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _split_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Cells of files whose quoted cells hold line breaks, with the file and an id in file order, read by many tasks.

    The files are cut into blocks of lines as usual. Each block's number of quotes says whether
    a cell is open behind it, and a prefix sum over a file's blocks whether one is open before
    it, so every line knows whether a record begins with it. Records of one line are parsed as
    they are; the lines of others are put together, from two blocks where they span them.
    """
    scanned = spark.read.text(path, lineSep="\n").select(
        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    along = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    counted = scanned.withColumn("q", _quotes(F.col("line"))).withColumn("through", F.sum("q").over(along))
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = scanned.groupBy("file", "block").agg(F.sum(_quotes(F.col("line"))).alias("q"))
    odd = odd.select("file", "block", (F.coalesce(F.sum("q").over(blocks), F.lit(0)) % 2).alias("open"))
    placed = counted.join(odd, ["file", "block"])
    begins = (F.col("through") - F.col("q") + F.col("open")) % 2 == 0
    ends = (F.col("through") + F.col("open")) % 2 == 0
    started = placed.select("file", "block", "n", "line", begins.alias("begins"), ends.alias("ends"))
    started = started.withColumn("record", F.last(F.when(F.col("begins"), F.col("n")), ignorenulls=True).over(along))
    carried = started.groupBy("file", "block").agg(F.max(F.when(F.col("begins"), F.col("n"))).alias("last"))
    carried = carried.select("file", "block", F.last("last", ignorenulls=True).over(blocks).alias("before"))
    alone = started.where("begins and ends").select("file", "n", F.rtrim(F.col("line"), F.lit("\r")).alias("record"))
    parts = started.where("not (begins and ends)").join(carried, ["file", "block"]).withColumn("record", F.coalesce("record", "before"))
    whole = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))  # of one record
    joined = whole.select("file", F.col("record").alias("n"), F.rtrim(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\r")).alias("record"))
    headers = scanned.where("block = 0").groupBy("file").agg(F.min("n").alias("n"))
    records = alone.unionByName(joined).where(F.trim("record") != "").join(headers, ["file", "n"], "left_anti")
    cells = F.from_csv("record", _ddl(schema), {"escape": '"', "encoding": "ISO-8859-1"})
    return records.select("file", "n", cells.alias("cells")).select("cells.*", F.col("file").alias("_file"), F.col("n").alias("_n"))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in schema.fieldNames())


def read_text_table(spark: SparkSession, path: str, multi_line: bool | None = None, ordered: bool = False) -> DataFrame:
    """All cells as text, header repaired, each file UTF-8 or else Latin-1.

    Files are read as Latin-1, which keeps every byte; a file whose cells are
    all valid UTF-8 is then decoded as that. Where a cell holds a line break, files
    are cut at true record ends and still read by many tasks; ``multi_line`` makes each
    file one task instead (True) or takes every line for a record (False). ``ordered``
    keeps the rows in file order on the way.
    """
    split = multi_line is None and _has_broken_lines(spark, path)
    head = spark.read.csv(path, header=False, multiLine=split or bool(multi_line), escape='"', encoding="ISO-8859-1").limit(1).first()
    if head is None:
        raise EmptyTable(f"{path} holds nothing")
    try:
        names = [n if n is None else n.encode("latin-1").decode("utf-8") for n in head]
    except UnicodeDecodeError:
        names = list(head)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in repaired_header(names)])
    inner = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema))])
    if split:
        table = _split_records(spark, path, inner)
        table = table.orderBy("_file", "_n") if ordered else table
    else:
        table = _read(spark, path, inner, bool(multi_line), "ISO-8859-1").withColumn("_file", F.col("_metadata.file_path"))
    sound = F.lit(True)
    for name in inner.fieldNames():
        sound = sound & F.coalesce(F.is_valid_utf8(_utf8(F.col(name))), F.lit(True))
    latin = table.where(~sound).select("_file").distinct()  # files that are not UTF-8
    if latin.isEmpty():
        return table.select(*(_utf8(F.col(n)) for n in inner.fieldNames())).toDF(*schema.fieldNames())
    marked = table.join(latin.withColumn("_latin", F.lit(True)), "_file", "left")
    marked = marked.orderBy("_file", "_n") if split and ordered else marked
    return marked.select(*(F.when(F.col("_latin"), F.col(n)).otherwise(_utf8(F.col(n))) for n in inner.fieldNames())).toDF(*schema.fieldNames())


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns become whole numbers, numbers or booleans where every value allows.

    Cells that mean missing become null first. Dates stay text; the profile
    recognises them by meaning. Costs one aggregate over the table.
    """
    texts = [f.name for f in df.schema.fields if is_text_type(f.dataType)]
    cells = {n: F.when(~F.col(f"`{n}`").isin(*MISSING_TOKENS), F.col(f"`{n}`")) for n in texts}
    wanted = []
    for i, name in enumerate(texts):
        text = strip_ws(cells[name])
        wanted += [
            F.count(cells[name]).alias(f"n{i}"),
            F.count(F.when(text.rlike(WHOLE_NUMBER), text.try_cast("long"))).alias(f"w{i}"),
            F.count_if(text.rlike(NUMBER_SHAPE)).alias(f"f{i}"),
            F.count_if(F.lower(cells[name]).isin(*TRUE_WORDS, *FALSE_WORDS)).alias(f"b{i}"),
        ]
    seen = df.agg(*wanted).first() if wanted else None
    typed = []
    for item in df.schema.fields:
        c = F.col(f"`{item.name}`")
        if item.name not in cells:
            typed.append(present(c, item.dataType).alias(item.name))
            continue
        i, cell = texts.index(item.name), cells[item.name]
        n = seen[f"n{i}"]
        if n == seen[f"w{i}"] and n:
            value = strip_ws(cell).try_cast("long")
        elif n == seen[f"f{i}"]:
            value = strip_ws(cell).try_cast("double")
        elif n == seen[f"b{i}"]:
            value = F.lower(cell) == "true"
        else:
            value = cell
        typed.append(value.alias(item.name))
    return df.select(*typed)


def require_rows(df: DataFrame) -> DataFrame:
    """Refuse a table without columns or rows; looks at one row only."""
    if not df.columns or df.limit(1).isEmpty():
        raise EmptyTable("the table has no rows or no columns")
    return df


def with_row_id(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """An id that grows in file order. It is not consecutive."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_csv_table(spark: SparkSession, path: str, multi_line: bool | None = None, row_id: bool = False) -> DataFrame:
    """A delimited file as a typed table, refused when empty."""
    table = read_text_table(spark, path, multi_line, ordered=row_id)
    if row_id:
        table = with_row_id(table)
    return infer_types(require_rows(table))


def read_parquet_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with NaN read as missing."""
    df = spark.read.parquet(path)
    return df.select(*[present(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
