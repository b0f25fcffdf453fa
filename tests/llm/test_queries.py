"""The registered queries and the pipeline over the given tables."""

import brute
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from tablescry.llm.registered import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def texts(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == ""


def test_substrings_lines_and_links(spark, con, texts):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for name, expected in (("op2_substring_dedup", brute.without_repeats(texts, 35)), ("op9_line_dedup", brute.line_dedup(texts))):
        got = {r[0]: tuple(r[1:]) for r in QUERIES[name](spark, FOLDER).collect()}
        assert got == {d: (a, b, sha(kept)) for (d, _), (a, b, kept) in zip(texts, expected, strict=True)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op7_near_dup"](spark, FOLDER).collect()}
    assert got == {d: e for (d, _), e in zip(texts, brute.near_duplicates(texts), strict=True)}
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op4_decontaminate"](spark, FOLDER).collect()}
    assert got == {d: e for (d, _), e in zip(texts, brute.contamination(texts, items, 13), strict=True)}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    con = connect(folder)
    langs = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    out = [r for r in QUERIES["op6_language_id"](spark, folder).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in out) >= 0.98 * len(out)
    marks = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    out = [r for r in QUERIES["op10_quality"](spark, folder).collect() if r.held_out and r.doc_id in marks]
    assert sum(r.predicted == marks[r.doc_id] for r in out) >= 0.95 * len(out)
    out = [r for r in QUERIES["op1_lm_scoring"](spark, folder).collect() if r.held_out]
    assert sum(r.score for r in out) > 0.97 * sum(r.base_score for r in out)


def test_pipeline_stage_by_stage(spark, con, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if number < 4:
            assert docs.columns == columns
        kept.append([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if number < 4 else docs.orderBy("start").collect())
    good, single, clean, mixture, tokens = kept
    marks = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    assert sum(marks.get(d) == 0 for d, _ in good) <= 0.1 * sum(q == 0 for q in marks.values())
    groups = brute.near_duplicates(good, 5, 80)
    assert sorted(d for d, _ in single) == sorted(d for (d, _), (_, low) in zip(good, groups, strict=True) if d == low)
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    assert sorted(clean) == sorted(r for r, e in zip(single, brute.contamination(single, items, 13), strict=True) if not e[4])
    assert sorted(mixture) == sorted(clean)
    assert [r.doc_id for r in tokens] == [d for d, _ in mixture]
    assert [r.start for r in tokens] == [sum(t.n_tokens for t in tokens[:i]) for i in range(len(tokens))]


def test_pipeline_takes_any_column_names(spark, tmp_path):
    extra = {"meta.url": "u", "score": "s", "_text_to_score": "t", "id": "i", "label": "l", "k_doc": "d", "nth": "n", "`": "q"}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    docs = docs.select("*", *(F.lit(v).alias(c) for c, v in extra.items()))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
    assert {tuple(r)[-len(extra):] for r in docs.collect()} == {tuple(extra.values())}
    assert corpus_pipeline.STAGES[4][1](spark, docs, FOLDER).count() == docs.count()
