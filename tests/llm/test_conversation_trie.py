"""The conversation trie against a plain one, at every size of shard."""

import random

import brute
import numpy as np
import pytest

from tablescry.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, key int, depth string, `meta.url` string, parent int"


def awkward_rows():
    rng = random.Random(4)
    openings = [("system", "Be brief. é"), ("user", "hello"), (None, None), ("user", "")]
    rows = []
    for c in range(70):
        first = [openings[0]] * 2 if c % 3 else [openings[rng.randrange(4)]]
        turns = first + [("user", f"say {rng.randrange(3)}") for _ in range(rng.randrange(7))]
        rows += [(c, i if i else (None if c % 4 == 0 else 0), *t) for i, t in enumerate(turns)]
    rows += [(200 + k, i, "user", f"same {i}") for k in range(40) for i in range(3)]  # equal conversations
    rows += [(305, i, "bot", f"long {i % 5}") for i in range(120)] + [(301, i, "bot", f"long {i % 5}") for i in range(90)]
    rows += [(3, 0, "user", "hello"), (3, 0, "user", "hello"), (3, 0, "bot", "tie"), (None, 0, "user", "nobody"), (904, 0, None, None), (905, None, None, "🙂")]
    return rows


@pytest.mark.parametrize("shard_rows", [200_000, 150, 20, 1])
def test_nodes(spark, shard_rows):
    rows = awkward_rows()
    table = spark.createDataFrame([(*r, 1, "d", "u", 2) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in ct.trie_nodes(table, shard_rows).collect()), key=repr)
    assert got == brute.trie(rows)


def test_empty_and_turnless(spark):
    assert ct.trie_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(4, 0, "user", "gone")]  # crc32 of "4" leaves at least one turn to conversation 0, which is absent
    table = spark.createDataFrame([(*r, 1, "d", "u", 2) for r in rows], SCHEMA)
    assert [tuple(r) for r in ct.trie_nodes(table).collect()] == brute.trie(rows)


def test_double_array_holds_scattered_children():
    rng = np.random.default_rng(3)
    trie, states, kept = ct.DoubleArray(), np.zeros(1, np.int64), []
    for _ in range(4):
        pairs = np.unique(np.concatenate([s * 1000 + rng.choice(1000, rng.integers(1, 9), replace=False) for s in states]))
        trie.add(pairs // 1000, pairs % 1000)
        states = trie.step(pairs // 1000, pairs % 1000)
        assert len(set(states.tolist())) == len(pairs) and (states > 0).all()
        kept.append((pairs, states))
    for pairs, states in kept:
        assert np.array_equal(trie.step(pairs // 1000, pairs % 1000), states)
        absent = np.setdiff1d(pairs // 1000 * 1000 + rng.integers(0, 1000, len(pairs)), pairs)
        assert (trie.step(absent // 1000, absent % 1000) < 0).all()
