import re

import pytest
from pyspark.sql import functions as F

from tablescry.operators import textjobs as tx
from tablescry.sources import csv as sc, tables as st


def numbers(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, t string")
    return sorted(r["number"] for r in tx.number_tokens(df, "t", ["id"]).collect())


@pytest.mark.parametrize("text, expected", [
    ("rose from 1,200 to 1200.00", [1200.0]), ("PM2.5 and Q1 and H2O", []), ("a drop of -20.5%.", [-20.5]),
    ("47kg in 3 boxes", [3.0, 47.0]), ("1.2.3", [1.2, 3.0]), ("1234567.8", [1234570.0]), ("0.000123456789", [0.000123457]), ("none", []),
])
def test_numbers_in_text(spark, text, expected):
    assert numbers(spark, text) == pytest.approx(expected)


def test_numbers_against_a_plain_reading(spark):
    text = " ".join(f"x{i} {i * 37.25}, a{i}b -{i},{i:03d} v.{i}" for i in range(1, 60))
    expected = set()
    for m in re.finditer(r"-?[0-9][0-9,]*\.?[0-9]*", text):
        if m.start() and text[m.start() - 1].isalpha():
            continue
        expected.add(float(f"{float(m.group().replace(',', '').rstrip('.')):.6g}"))
    assert numbers(spark, text) == pytest.approx(sorted(expected))


def test_grounding(spark):
    texts = spark.createDataFrame([(1, "fell 20% to 4,500"), (2, "rose 99.5"), (3, "top 3 of 12"), (4, "no numbers"), (5, None)], "id long, t string")
    allowed = spark.createDataFrame([(-20.0,), (4500.0,)], "number double")
    got = {r["id"]: (r["n_numbers"], r["n_unsupported"], r["grounded"]) for r in tx.grounding_audit(texts, "t", ["id"], allowed).collect()}
    assert got == {1: (2, 0, True), 2: (1, 1, False), 3: (2, 0, True), 4: (0, 0, True), 5: (0, 0, True)}


@pytest.mark.parametrize("text, expected", [
    ("What is the most important thing here?", "overview"), ("any anomalies in sales", "outliers"), ("the meaning of life", None),
    ("is it growing", "trend"), ("which region sells best", "rank"), ("mean salary", "aggregate"), ("how many rows", "count"),
    ("describe it", "describe"), ("does advertising affect revenue", "relationship"), ("oddity", None),
])
def test_intents(spark, text, expected):
    df = spark.createDataFrame([(1, text)], "id long, t string")
    assert tx.tag_intent(df, "t", ["id"]).first()["intent"] == expected


def test_mentioned_columns_longest_first(spark):
    df = spark.createDataFrame([(1, "Sales Region and paid sales")], "id long, t string")
    assert tx.mentioned_columns(df, "t", ["id"], ["sales", "id", "sales_region"]).first()["mentioned"] == ["sales_region", "sales"]


def write(tmp_path, data, name="f.csv"):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_types_header_and_missing_tokens(spark, tmp_path):
    path = write(tmp_path, "a,a,,flag,when\n1,1.5,x,True,2024-01-01\nNA,n/a,,False,2024-01-02\n3,,y,TRUE,\n")
    df = sc.read_csv_table(spark, path)
    assert df.dtypes == [("a", "bigint"), ("a.1", "double"), ("Unnamed: 2", "string"), ("flag", "boolean"), ("when", "string")]
    assert [tuple(r) for r in df.orderBy("when").collect()][-1] == (None, None, None, False, "2024-01-02")


def test_latin_1_fallback(spark, tmp_path):
    df = sc.read_csv_table(spark, write(tmp_path, "ville,n\nOrléans,1\n".encode("latin-1")))
    assert df.first()["ville"] == "Orléans"
    assert sc.read_csv_table(spark, write(tmp_path, "ville,n\nOrléans,1\n", "u.csv")).first()["ville"] == "Orléans"


def test_quoted_line_breaks_and_row_id(spark, tmp_path):
    path = write(tmp_path, 'a,b\n"line one\nline two",1\n"said ""hi""",2\n')
    df = sc.read_csv_table(spark, path, multi_line=True, row_id=True).orderBy("_row_id")
    assert [r["a"] for r in df.collect()] == ["line one\nline two", 'said "hi"']


def test_empty_files_refused(spark, tmp_path):
    with pytest.raises(sc.EmptyTable):
        sc.read_csv_table(spark, write(tmp_path, "a,b\n"))
    with pytest.raises(sc.EmptyTable):
        sc.read_csv_table(spark, write(tmp_path, "", "none.csv"))


def test_header_repair():
    assert sc.repaired_header(["a", "a", None, "a.1", " "]) == ["a", "a.1", "Unnamed: 2", "a.1.1", "Unnamed: 4"]


def test_records_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "k long, v double")
    assert [r["v"] for r in st.as_records(df).orderBy("k").collect()] == [None, None, 1.5]
    st.write_records(df, str(tmp_path / "records"))
    assert spark.read.json(str(tmp_path / "records")).count() == 3
    root = str(tmp_path / "versions")
    st.save_version(df, root, "original")
    assert st.read_version(spark, root).count() == 3
    st.save_version(df.limit(1), root, "cleaned")
    assert st.read_version(spark, root).count() == 1 and st.read_version(spark, root, "original").count() == 3


def test_preview(spark):
    df = spark.range(500)
    cut = st.preview(df, 1000, ["id"]).collect()
    assert len(cut) == 200 and cut[0]["total_rows"] == 500 and cut[0]["truncated"]
    assert not st.preview(df.limit(10), 50, ["id"]).first()["truncated"]


def test_parquet_nan_is_missing(spark, tmp_path):
    spark.createDataFrame([(float("nan"),), (2.0,)], "v double").write.parquet(str(tmp_path / "p"))
    assert sc.read_parquet_table(spark, str(tmp_path / "p")).agg(F.count("v").alias("n")).first()["n"] == 1


def test_quoted_line_breaks_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    import csv
    import random

    rng, expected = random.Random(2), []
    cells = ["plain", "a\nb", 'q"uo\nte"d', "x,\n\ny,z", "é" * 5, "line\r\nend", "", "\n" * 60 + "t"]
    for number, (code, end) in enumerate((("utf-8", "\n"), ("latin-1", "\r\n"))):
        rows = [(str(number * 1000 + i), rng.choice(cells), rng.choice(["k", 'a "b"', ""])) for i in range(200)]
        expected += rows
        with open(tmp_path / f"p{number}.csv", "w", newline="", encoding=code) as out:
            writer = csv.writer(out, lineterminator=end)
            writer.writerows([["id", "te.xt", "k"], *rows])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(kept, ("2k", "1"), strict=True):
            spark.conf.set(k, v)
        table = sc.read_text_table(spark, str(tmp_path), ordered=True)
        assert [tuple(c or "" for c in r) for r in table.collect()] == expected
        blocks = spark.read.text(str(tmp_path), lineSep="\n").select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        assert blocks > 4
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
