"""Each training-text operator against a plain version, on tables with every awkward row."""

import random
from collections import Counter
from types import SimpleNamespace

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablescry.llm import components as component_rounds
from tablescry.llm.components import components
from tablescry.llm import common, decontaminate, exact_search, language_id, line_dedup, lm_scoring, mixing, near_dup, quality, substring_dedup, token_output

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, start int, label int, key string, anchor string, uid int, _text string"


def awkward_texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "of", "é", "ñandú", "don't", "|"]
    passage = " ".join(rng.choices(vocabulary, k=60))
    line = "This Line stands in many documents, verbatim."
    texts = [None, "", " \n\t", "one", "two words", "\n\n", "🙂 ünïcodé text", "!!! ???", "a " * 90, "A\x0bB\x0cC\rD"]
    for i in range(24):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(1, 160)))
        if i % 3 == 0:
            text = f"{text}\n {passage}\t{text[:40]}"
        if i % 4 == 0:
            text = f"{text}\n  {line.upper() if i % 8 else line} \n{text[:30]}\n{line}"
        texts.append(text)
    base = rng.choices(vocabulary, k=120)
    for i in range(12):  # near copies
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"edit{i}"
        texts.append(" ".join(copy))
    texts.append(" ".join(rng.choices(vocabulary, k=30_000)))
    texts += texts[12:15]
    return texts


@pytest.fixture(scope="module")
def rows():
    rows = [(i * 3 + 1, t) for i, t in enumerate(awkward_texts())]
    return [*rows, rows[14], rows[14], (None, rows[20][1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(d, t, ("en", "fr", None)[i % 3], ("a", "a", "b", None)[i % 4], len(t or ""), "x", 1, 2, "k", "z", 9, "t") for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(frame, columns, rows, expected):
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    assert got == sorted(((d, *e) for (d, _), e in zip(rows, expected, strict=True)), key=repr)


def test_lm_base_score_and_gain(docs, rows, none):
    learned = ~common.held_out(F.col("doc_id"), 7, 2)
    out = lm_scoring.score_documents(docs, learned).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out), key=repr)
    assert got == sorted(((d, *e[:3], round(e[3], 4)) for (d, _), e in zip(rows, brute.base_scores(rows), strict=True)), key=repr)
    assert all(np.isfinite(r.score) and r.score < 0 for r in out)
    assert lm_scoring.score_documents(none, learned).count() == 0


def test_lm_chances_sum_to_one_and_carry_the_state(spark):
    counts = spark.createDataFrame([(lm_scoring.END, 5)] + [(f"w{i}".encode(), 200 - i) for i in range(150)], "word binary, n long")
    vocabulary = lm_scoring.Vocabulary(counts)
    network = lm_scoring.Network(vocabulary)
    state = np.random.default_rng(1).normal(size=(1, lm_scoring.WIDTH)).astype(np.float32)
    every = np.arange(vocabulary.net + lm_scoring.TAIL_CLASSES)
    logs, _ = network.log_chances(np.repeat(state, len(every), axis=0), every)
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    symbols = np.random.default_rng(2).integers(0, vocabulary.net, 3 * lm_scoring.STEPS + 5).astype(np.int32)
    at_once = np.concatenate([[0], symbols[:-1]]).reshape(-1, 1)
    fresh = np.zeros(at_once.shape, bool)
    fresh[0] = True
    _, whole = network.read(at_once, fresh, np.zeros((1, lm_scoring.WIDTH), np.float32))
    h, parts = np.zeros((1, lm_scoring.WIDTH), np.float32), []
    for inputs, _, _, starts in lm_scoring.Lanes([symbols]).windows():
        h, kept = network.read(inputs, starts, h[: inputs.shape[1]])
        parts.append(kept["h"])
    assert np.allclose(np.concatenate(parts), whole["h"], atol=1e-6)


def test_lm_lanes_take_the_memory_of_their_symbols():
    documents = [np.full(20, i, np.int32) for i in range(400)] + [np.arange(1_000_000, dtype=np.int32)]
    lanes = lm_scoring.Lanes(documents)
    assert sum(getattr(lanes, name).nbytes for name in ("targets", "document", "fresh", "inputs")) < 14 * sum(map(len, documents))
    seen, windows = np.zeros(len(documents), np.int64), 0
    for inputs, targets, document, fresh in lanes.windows():
        assert inputs.size <= 2 * lm_scoring.LANES * lm_scoring.STEPS and (targets[document == 400] >= 0).all()
        seen += np.bincount(document[document >= 0], minlength=len(documents))
        windows += 1
    assert seen.tolist() == [len(d) for d in documents] and windows < 1_000_000 // lm_scoring.MOST_STEPS + 40


def test_lm_every_token_is_learnt_from(spark, monkeypatch):
    counts = spark.createDataFrame([(lm_scoring.END, 5)] + [(f"w{i}".encode(), 200 - i) for i in range(150)], "word binary, n long")
    vocabulary = lm_scoring.Vocabulary(counts)
    texts = [" ".join(f"w{(i * k) % 150}" for k in range(words)) for i, words in enumerate((10, 40, 48, 100, 333), 1)]
    learnt, learn = Counter(), lm_scoring.Network.learn

    def noted(network, inputs, targets, weights, *others):
        learnt.update(targets[weights > 0].tolist())
        return learn(network, inputs, targets, weights, *others)

    monkeypatch.setattr(lm_scoring.Network, "learn", noted)
    train = lm_scoring._trainer(SimpleNamespace(value=vocabulary), SimpleNamespace(value=lm_scoring.Network(vocabulary).flat))
    batches = [pa.record_batch({"text": texts[:2]}), pa.record_batch({"text": texts[2:]})]  # each document has a lane of its own
    tokens = sum(row["tokens"] for out in train(iter(batches)) for row in out.to_pylist())
    every = Counter(vocabulary.symbols([w for t in texts for w in [*lm_scoring.words_of(t.encode()), lm_scoring.END]])[0].tolist())
    assert learnt == every and tokens == every.total()


def test_lm_words_are_cut_like_plain_text(spark, monkeypatch):
    texts = ["A b  a", None, "", "  ", " x\x0b\x0cB\t\r\nx ", "\x00 \x00\x00 \x1c", "É é ÄB a\u00a0b a\u2028b", "end."] * 3
    monkeypatch.setattr(lm_scoring, "SLICE", 10)  # several slices, the later ones do not begin with the array
    counts = spark.createDataFrame([(lm_scoring.END, 5), (b"a", 4), (b"x", 2)], "word binary, n long")
    vocabulary = lm_scoring.Vocabulary(counts)
    got = [one.tolist() for _, symbol, _, tokens, offsets in lm_scoring._encoded(pa.array(texts), vocabulary) for one in lm_scoring._by_text(symbol[tokens], offsets)]
    plain = [[*(t or "").encode().lower().split(), lm_scoring.END] for t in texts]
    assert got == [vocabulary.symbols(words)[0].tolist() for words in plain]
    counted = Counter()
    for out in lm_scoring._count(iter([pa.record_batch({"text": texts})])):
        counted.update(dict(zip(out["word"].to_pylist(), out["n"].to_pylist(), strict=True)))
    assert counted == {lm_scoring.END: len(texts)} | Counter(w for words in plain for w in words[:-1])  # U+0000 is a word of its own


def test_lm_short_rounds_take_longer_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i % 7} c") for i in range(400)], "doc_id long, text string").repartition(64).localCheckpoint()
    vocabulary = lm_scoring.Vocabulary(spark.createDataFrame([(lm_scoring.END, 400), (b"a", 400), (b"c", 400)], "word binary, n long"))
    parts, plain = [], type(docs).mapInArrow

    def noted(frame, function, *others):
        if function.__name__ == "train":
            parts.append(frame.rdd.getNumPartitions())
        return plain(frame, function, *others)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    assert np.isfinite(lm_scoring.train(docs, vocabulary)).all()
    least = spark.sparkContext.defaultParallelism
    assert parts == [max(least, n) for n in (8, 8, 16, 32, 64)]


def test_lm_softmax_of_large_weights(spark):
    counts = spark.createDataFrame([(lm_scoring.END, 5)] + [(f"w{i}".encode(), 200 - i) for i in range(150)], "word binary, n long")
    vocabulary = lm_scoring.Vocabulary(counts)
    network = lm_scoring.Network(vocabulary)
    every, state = np.arange(vocabulary.net + lm_scoring.TAIL_CLASSES), np.ones((1, lm_scoring.WIDTH), np.float32)
    for name in ("wc", "wo"):
        network.w[name] *= 40
    logs, _ = network.log_chances(np.repeat(state, len(every), axis=0), every)
    assert np.isfinite(logs).all() and np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_lm_gradient_is_the_slope():
    class Known:
        net, classes, n = 70, 2, np.arange(70, 0, -1.0)
        tail_n, tail_v = np.ones(lm_scoring.TAIL_CLASSES), np.ones(lm_scoring.TAIL_CLASSES)

    rng = np.random.default_rng(3)
    inputs, targets = rng.integers(0, 75, (4, 3)), rng.integers(0, 75, (4, 3))
    fresh = rng.random((4, 3)) < 0.3
    h = rng.normal(size=(3, lm_scoring.WIDTH)).astype(np.float32)
    network = lm_scoring.Network(Known())

    class Slopes:
        def __init__(self):
            self.found = {k: np.zeros_like(v, dtype=float) for k, v in network.w.items()}

        def step(self, name, gradient, at=slice(None)):
            self.found[name][at] += gradient

    slopes = Slopes()
    network.learn(inputs, targets, np.ones((4, 3), np.float32), fresh, h, slopes)

    def loss():
        _, kept = network.read(inputs, fresh, h)
        return -float(network.log_chances(kept["h"].reshape(-1, lm_scoring.WIDTH), targets.ravel())[0].astype(float).mean())

    for name in ("wx", "wh", "b", "wc", "emb", "wo"):
        at = np.unravel_index(np.abs(slopes.found[name]).argmax(), slopes.found[name].shape)
        old = network.w[name][at]
        network.w[name][at] = old + 0.02
        up = loss()
        network.w[name][at] = old - 0.02
        down = loss()
        network.w[name][at] = old
        assert (up - down) / 0.04 == pytest.approx(slopes.found[name][at], rel=0.1, abs=1e-3)


@pytest.mark.parametrize("window,anchor", [(35, 8), (12, 3)])
def test_substring_dedup(docs, rows, none, window, anchor):
    out = substring_dedup.without_repeats(docs, window, anchor)
    same(out, ["doc_id", "n_words", "n_removed", "kept"], rows, brute.without_repeats(rows, window))
    assert substring_dedup.without_repeats(none).count() == 0


def test_least_places():
    values = np.random.default_rng(0).integers(0, 6, 200)
    for width in (1, 2, 5, 28):
        expected = [i + int(values[i : i + width].argmin()) for i in range(len(values) - width + 1)]
        assert substring_dedup.least_places(values, width).tolist() == expected


def test_mixing_keeps_all_rows_and_shares(docs, rows, none):
    weights = {"a": 3, "b": 2, None: 1}
    out = mixing.mix(docs, weights, block_chars=400).collect()
    assert sorted((r.doc_id for r in out), key=repr) == sorted((d for d, _ in rows), key=repr)
    lengths = {}
    for r in out:
        lengths[r._source] = max(lengths.get(r._source, 0), r._block + 1)
    assert len({(r._source, r._block) for r in out}) == len({r._slot for r in out})  # a slot holds one block
    assert mixing.mix(none, weights).count() == 0
    ordered = mixing.in_mixed_order(docs, weights, block_chars=400)
    assert ordered.columns == docs.columns and ordered.count() == docs.count()


def test_mixing_deviates_less_than_a_block(spark):
    for shares in ([3, 2, 1], [1, 1, 1, 7], [5], [0, 4, 9, 2]):
        table = spark.range(1).select(F.array(*map(F.lit, shares)).alias("shares"))
        slots = table.select(mixing._earliest_deadlines(F.col("shares"), F.lit(sum(shares)))).first()[0]
        assert slots == brute.earliest_deadlines(shares)
        for t in range(1, sum(shares) + 1):
            assert all(abs(slots[:t].count(k) - t * q / sum(shares)) < 1 for k, q in enumerate(shares))


def test_mixing_balances_sources(spark):
    rows = [(i, "x" * 99, "hot" if i % 3 else "cold", 0) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = mixing.mix(table, {"hot": 1, "cold": 1}, block_chars=1000).orderBy("_slot", "_offset").collect()
    for end in (200, 700, 1500):
        hot = sum(r._source == "hot" for r in out[:end])
        assert abs(hot - end / 2) <= 10


ITEMS = [(7, " ".join(f"w{i}" for i in range(20))), (8, "short item here"), (8, "short item here"), (9, None), (None, "w1 w2"), (10, "..."), (11, "x1 " * 40)]


@pytest.mark.parametrize("pass_words", [10_000, 30])
def test_decontamination(spark, rows, docs, none, pass_words):
    extra = [(9001, "before " + ITEMS[0][1].upper() + ", after"), (9002, "A SHORT item, here!"), (9003, "w1 " * 30), (9004, " ".join(f"w{i}" for i in range(12))), (9005, "x1 " * 14)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.with_verdict(decontaminate.find_items(table, items, pass_words=pass_words))
    out = out.withColumn("n_items", F.size("_items")).withColumn("hash", F.sha2(F.array_join("_items", ","), 256))
    everything = [*rows, *extra]
    expected = brute.contamination(everything, ITEMS, 13)
    same(out, ["doc_id", "n_words", "n_hit", "n_items", "hash", "contaminated"], everything, expected)
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not e[4] for e in brute.contamination(rows, ITEMS, 13))
    assert decontaminate.without_contaminated(none, items).count() == 0
    assert decontaminate.without_contaminated(docs, items.limit(0)).count() == len(rows)


def test_decontamination_cuts_spans(spark):
    table = spark.createDataFrame([(1, "Keep this. " + ITEMS[0][1] + " and this."), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    assert {r.doc_id: r.text for r in decontaminate.without_spans(table, items).collect()} == {1: "Keep this.  and this.", 2: None}


def test_exact_search(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(9)], 0) for i in range(400)]
    vectors += [(i, vectors[3][1], 0) for i in range(400, 560)]  # many equal
    vectors += [(600, None, 0), (601, [None] * 9, 0), (602, [float("nan")] * 9, 0), (603, [float("inf")] * 9, 0), (None, vectors[0][1], 0), (650, [0.5, -0.25], 0), (1, vectors[1][1], 0)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score int")
    sound = {i: np.floor(np.array(v + [0.0] * (9 - len(v))) * 256) for i, v, _ in vectors if i is not None and v and None not in v and np.isfinite(v).all()}
    got = exact_search.top_k(table, F.col("id") % 50 == 0).collect()
    expected = []
    for q in sound:
        if q % 50 == 0:
            best = sorted((-int(sound[q] @ sound[c]), c) for c in sound if c != q)[:5]
            expected += [(q, k, c, -s) for k, (s, c) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(expected)
    assert exact_search.top_k(table.limit(0), F.col("id") % 50 == 0).count() == 0
    assert exact_search.top_k(table.where("vec_id in (0, 2)"), F.col("id") % 50 == 0).count() == 1  # fewer than k


def test_cover_tree_invariants():
    vectors = np.random.default_rng(4).normal(size=(500, 6))
    ids, placed, nodes, radii = exact_search.build_tree(np.arange(500), vectors)
    assert sorted(ids.tolist()) == list(range(500)) and np.array_equal(placed, vectors[ids])
    for (first, end, child, count), radius in zip(nodes.tolist(), radii, strict=True):
        assert np.linalg.norm(placed[first:end] - placed[first], axis=1).max() <= radius + 1e-9
        if count:
            assert nodes[child][0] == first and nodes[child + count - 1][1] == end


def test_language_id(docs, rows, none):
    model = language_id.train(docs)
    out = language_id.identify(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    lettered = {repr(d): any(c.isalpha() for c in t or "") for d, t in rows if d is not None}
    assert all((r.lang_pred != "und") == lettered[repr(r.doc_id)] for r in out if r.doc_id is not None)
    assert language_id.identify(none, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(none)).collect()} == {"und"}


def test_gram_buckets_do_not_cross_texts():
    texts = ["Ab c", "", "éA1", "x"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    whole, bounds, lettered = language_id.gram_buckets(*common.code_points(np.frombuffer(data, np.uint8), offsets), 12)
    assert lettered.tolist() == [True, False, True, True]
    for i, t in enumerate(texts):
        alone, _, _ = language_id.gram_buckets(*common.code_points(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])), 12)
        assert np.array_equal(whole[:, bounds[i] : bounds[i + 1]], alone)


def test_near_duplicates(docs, rows, none):
    out = near_dup.near_duplicates(docs)
    named = [(r, e) for r, e in zip(rows, brute.near_duplicates(rows), strict=True) if r[0] is not None]
    got = out.where("doc_id is not null").withColumn("same", F.col("kept") == (F.col("doc_id") == F.col("component_id")))
    same(got, ["doc_id", "n_shingles", "component_id", "same"], [r for r, _ in named], [(*e, True) for _, e in named])
    assert near_dup.near_duplicates(none).count() == 0
    kept = near_dup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({d for (d, _), e in named if d == e[1]})


def test_near_duplicates_in_a_large_group(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # linked to the base more often than to each other
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(60)] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(copy)))
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    same(out, ["doc_id", "n_shingles", "component_id"], rows, brute.near_duplicates(rows))


@pytest.mark.parametrize("last_edges", [0, 2_000])
def test_components_of_a_shuffled_path_take_few_rounds(spark, monkeypatch, last_edges):
    monkeypatch.setattr(component_rounds, "LAST_EDGES", last_edges)
    ids = list(range(2000))
    random.Random(1).shuffle(ids)
    tables = common.Tables(spark)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (5000, 5001), (5001, 5000), (7000, 7000), (None, 1)], "a long, b long")
    found = {r.node: r.label for r in components(edges, tables).collect()}
    assert found == {i: 0 for i in ids} | {5000: 5000, 5001: 5000, 7000: 7000}
    assert len(tables.paths) <= 2 * 20 + 4
    assert components(edges.limit(0), common.Tables(spark)).count() == 0


def test_drifting_copies_are_one_group(spark):
    rng = random.Random(6)
    words, rows = [f"w{i}" for i in range(90)], []
    ids = list(range(800))
    rng.shuffle(ids)
    for i in ids:
        rows.append((i, " ".join(words)))
        words[rng.randrange(90)] = f"e{rng.randrange(10**6)}"
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    same(out, ["doc_id", "n_shingles", "component_id"], rows, brute.near_duplicates(rows))


def test_rows_are_judged_by_their_text(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a), (5, a), (5, b), (7, b), (None, "c " + a), (None, None), (8, None), (8, None)]
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, `meta.url` string, label int")
    got = sorted((tuple(r) for r in near_dup.near_duplicates(table).select("doc_id", "component_id", "kept").collect()), key=repr)
    expected = [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (None, 3, False), (None, None, True), (8, 8, True), (8, 8, True)]
    assert got == sorted(expected, key=repr)
    kept = near_dup.without_near_duplicates(table)
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(3, a), (5, b), (None, None), (8, None)], key=repr)


def test_a_null_id_joins_its_neighbours(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(w) for w in (words, [*words[:-3], "x", "y", "z"], [*words[3:-3], "x", "y", "z", "p", "q", "r"])]
    sets = [brute.shingles(t, 3) for t in texts]
    share = [100 * len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in ((0, 1), (1, 2), (0, 2))]
    percent = int(min(share[:2]))
    assert share[2] < percent
    rows = [(1, texts[0]), (None, texts[1]), (2, texts[2])]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent)
    assert {r.component_id for r in out.collect()} == {1}


def test_fewer_places_are_asked_of_less_similar_sets(spark):
    assert [near_dup.matches(p) for p in (100, 85, 80, 60, 5)] == sorted((near_dup.matches(p) for p in (100, 85, 80, 60, 5)), reverse=True)
    rng, rows = random.Random(8), []
    for i in range(120):
        words = [f"d{i}w{k}" for k in range(60)]
        rows.append((2 * i, " ".join(words)))
        for k in rng.sample(range(0, 60, 4), 5):
            words[k] = f"x{k}"
        rows.append((2 * i + 1, " ".join(words)))
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=60)
    same(out, ["doc_id", "n_shingles", "component_id"], rows, brute.near_duplicates(rows, 3, 60))


def test_shingle_sets_are_those_of_each_text_alone():
    texts = ["a b c d", "", "a", "A  b", "a b c d a b c d"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    hashes, bounds = near_dup.shingle_sets(data, np.cumsum([0] + [len(t) for t in texts]), 3)
    assert np.diff(bounds).tolist() == [2, 0, 1, 1, 4]
    assert set(hashes[bounds[0] : bounds[1]].tolist()) <= set(hashes[bounds[4] : bounds[5]].tolist())


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path(token_output.TOKENIZER)


def test_token_file_round_trip(spark, docs, rows, none, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, stream = [], []
    for d, t in order:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        expected.append((d, len(stream), len(ids), __import__("zlib").crc32(np.array(ids, "<u4").tobytes())))
        stream += ids
    folder = str(tmp_path / "tokens")
    token_output.write_tokens(docs, folder, tokenizer, block_tokens=500)
    got = token_output.read_documents(spark, folder).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected
    places = [0, 1, len(stream) // 2, len(stream) - 1, len(stream), -1]
    assert {r.place: r.id for r in token_output.tokens_at(spark, folder, places).collect()} == {p: stream[p] for p in places[:4]}
    token_output.write_tokens(none, str(tmp_path / "empty"), tokenizer)
    assert token_output.read_documents(spark, str(tmp_path / "empty")).count() == 0


def test_pieces_encode_like_whole_texts(tokenizer):
    from tokenizers import Tokenizer

    whole, pieces = Tokenizer.from_file(tokenizer), token_output.PieceEncoder(tokenizer, known_pieces=20)
    texts = ["it's they're", "a<|endoftext|>b", "T̈e é É", "x_y.z 12ab3 ª5º µ²", "A b\x1cc\x85d", "ΑΣ ΟΔΟΣ İ", "漢字 かな", "...!!! ###", "", None, " lead trail ", "Ünï ß ÿ"]
    for text in texts * 2:
        assert np.frombuffer(pieces.encode(text), "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


def test_directly_addressable_codes():
    rng = np.random.default_rng(8)
    ids = np.concatenate([rng.integers(0, 2**b, 700) for b in (4, 8, 9, 17, 32)]).astype(np.uint32)
    rng.shuffle(ids)
    levels, marks, ranks = token_output.pack(ids)
    assert np.array_equal(token_output.unpack(levels, marks), ids)
    assert [token_output.token_at(levels, marks, ranks, i) for i in range(len(ids))] == ids.tolist()


def test_line_dedup(docs, rows, none):
    same(line_dedup.deduplicate_lines(docs), ["doc_id", "n_lines", "n_dropped", "kept_text"], rows, brute.line_dedup(rows))
    assert line_dedup.deduplicate_lines(none).count() == 0


def test_line_runs_stay_unique_and_levelled(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path), fan_out=2)
    for batch in range(5):
        runs.add(spark.createDataFrame([(batch * 10 + i, f"k{i % (batch + 2)}") for i in range(batch + 2)], "doc_id long, key string"))
    held = runs._read(sum(runs.levels, []))
    assert held.count() == held.select("key").distinct().count() == 6
    assert len(sum(runs.levels, [])) == 2  # five runs: one of four and one of one
    assert {r.key: r.last for r in runs.frequent(3).collect()} == {"k0": 40, "k1": 41, "k2": 42, "k3": 43}


def test_trees_learn_what_no_single_cut_shows():
    x = np.random.default_rng(0).random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.fit_trees(x, y, rounds=40)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    assert quality.fit_trees(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality.fit_trees(x[:5], np.ones(5)).score(x[:2]) > 0.9).all()


def test_quality_scores_every_row(spark, docs, rows, none):
    labels = spark.createDataFrame([(d, i % 2, 0) for i, (d, _) in enumerate(rows)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    trees = quality.train(docs, labels)
    out = quality.score_quality(docs, trees).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    kept = quality.score_quality(docs, trees, keep=docs.columns, only_good=True)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)
    assert quality.score_quality(none, quality.train(none, labels)).count() == 0
