"""Log-likelihood of whole documents under a gated recurrent language model.

Counts of all words of the training documents come from one Spark aggregation. The
``NET_WORDS`` most frequent words are dealt into classes of equal size; every other word
falls into one of a few tail classes by its last character and its accents. A small GRU
reads the words before and gives a softmax over classes; within a class of frequent words
a second softmax gives the word, within a tail class its share of the class's counts does,
with one count for words never seen. The output starts at the unigram shares, so training
only has to learn what the context adds.

Training is truncated backpropagation in numpy inside the tasks: documents lie one behind
the other in lanes, the state is carried from window to window and reset where a document
begins, and every window is backpropagated. After each round, over a growing share of the
documents and over all of them in the end, the tasks' weights are averaged in two steps of
partial sums, so the driver gets a few rows. Rounds over small shares take fewer and longer
parts, because the longest text of a part keeps few lanes busy.

Words are cut and told apart by Arrow, a few MB of text at a time, and looked up once each.
Softmaxes stay as exponentials with their totals; tokens are sorted by target for them.

Scoring carries the state through each complete document. The tasks know the counts of the
``KNOWN_WORDS`` most frequent words; occurrences of others are joined with the counts.

Defined cases: null or empty text is the end token alone; a null doc_id trains as empty
text's id would; without training documents N and V are 0 and every token has the chance
of an unseen one; repeated rows count each; very long texts are read like any other, a
window at a time, and take the memory of their symbols; other columns, whatever their
names, are not looked at; an empty table gives an empty result. Weights depend in the last
digits on how files are split into tasks and batches, and so do scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heapreplace
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescry.llm.common import held_out, sums_between, text_slices
from tablescry.plans.derived import load
from tablescry.session import cut_lineage

NET_WORDS, CLASS_WORDS, KNOWN_WORDS = 4096, 64, 1 << 16
WIDTH, LANES, STEPS, MOST_STEPS = 16, 384, 16, 256
RATE, SEED = 0.08, 7
ROUND_SHARES = (1, 1, 2, 4, 8)  # sixteenths of the training documents
END = b" "  # no word holds it
SLICE = 4 << 20  # bytes of text whose words are looked up together
_ENDINGS = (b".", b",", b"!?", b"*#$%&", b"|", b";:", b"0123456789")
_ACCENTS = ("äöüß", "éèêçàâùûîœ", "ñóíáú")
TAIL_CLASSES = (len(_ENDINGS) + 1) * (len(_ACCENTS) + 2)
_ENDING_OF = np.full(256, len(_ENDINGS), np.int64)
for _i, _group in enumerate(_ENDINGS):
    _ENDING_OF[list(_group)] = _i
_ACCENTED = re.compile("|".join(f"([{group}])" for group in _ACCENTS))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of one text."""
    return text.lower().split() if text else []


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased words of texts, the number of each word in them, and the texts' offsets among those."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data.tobytes().lower())]
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers))
    coded, offsets = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
    numbers, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary())
    full = pc.binary_length(words).to_numpy() > 0  # white space at either end of a text gives empty words
    if not full.all():
        kept = full[numbers]
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        numbers, words = (np.cumsum(full, dtype=np.int32) - 1)[numbers[kept]], words.filter(pa.array(full))
    return words, numbers, offsets


def tail_classes(words: list[bytes]) -> np.ndarray:
    """The tail class of each word, by its last character and its first accent."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes)
    classes = _ENDING_OF[data[ends - 1]]
    accented = np.unique(np.searchsorted(ends, np.flatnonzero(data > 127), side="right")) if len(words) else []
    for i in accented:
        first = _ACCENTED.search(words[i].decode("utf-8", "replace"))
        classes[i] += (first.lastindex if first else len(_ACCENTS) + 1) * (len(_ENDINGS) + 1)
    return classes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in text_slices(batch["text"], SLICE):
            words, numbers, _ = split_words(data, offsets)
            yield pa.record_batch({"word": words.cast(pa.binary()), "n": pa.array(np.bincount(numbers, minlength=len(words)), pa.int64())})
        yield pa.record_batch({"word": pa.array([END], pa.binary()), "n": pa.array([batch.num_rows], pa.int64())})


def _by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, v = np.zeros(TAIL_CLASSES, np.int64), np.zeros(TAIL_CLASSES, np.int64)
    for batch in batches:
        of = tail_classes(batch["word"].to_pylist())
        n += np.bincount(of, batch["n"].to_numpy(), TAIL_CLASSES).astype(np.int64)
        v += np.bincount(of, minlength=TAIL_CLASSES)
    yield pa.record_batch({"kind": pa.array(range(TAIL_CLASSES), pa.int32()), "n": pa.array(n), "v": pa.array(v)})


class Vocabulary:
    """Most frequent words with their counts, and the totals of the tail classes."""

    def __init__(self, counts: DataFrame):
        top = counts.orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).toArrow()
        words, n = [bytes(w) for w in top["word"].to_pylist()], top["n"].to_pylist()
        ends = n[words.index(END)] if END in words else 0
        rest = [(w, c) for w, c in zip(words, n, strict=True) if w != END]
        self.place = {END: 0} | {w: i for i, (w, _) in enumerate(rest, 1)}
        self.n = np.array([ends] + [c for _, c in rest], float)
        self.net = min(NET_WORDS, len(self.n))
        kinds = tail_classes([w for w, _ in rest])
        by_class = counts.mapInArrow(_by_class, "kind int, n long, v long").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
        self.tail_n, self.tail_v = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
        for r in by_class:
            self.tail_n[r["kind"]], self.tail_v[r["kind"]] = r["n"], r["v"]
        self.tokens, self.distinct = sum(r["n"] for r in by_class), sum(r["v"] for r in by_class)
        own = np.concatenate([tail_classes([END])[: int(ends > 0)], kinds[: self.net - 1]])  # words of the network are no tail
        self.tail_n -= np.bincount(own, self.n[int(ends == 0) : self.net], TAIL_CLASSES)
        self.tail_v -= np.bincount(own, minlength=TAIL_CLASSES)
        self.symbol = np.concatenate([np.arange(self.net), self.net + kinds[self.net - 1 :]]).astype(np.int32)

    @property
    def classes(self) -> int:
        return -(-self.net // CLASS_WORDS)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The network's symbol of each word, and its place among the known words (-1: not known)."""
        place = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        symbol = self.symbol[place]
        new = np.flatnonzero(place < 0)
        symbol[new] = self.net + tail_classes([words[i] for i in new.tolist()])
        return symbol, place


class Network:
    """GRU with class-factored softmax; its weights are one flat vector, viewed as arrays.

    ``wx``, ``wh`` and ``b`` hold the reset gate, the update gate and the new state one after
    the other; the last row of ``wc`` and of each class in ``wo`` is the bias. What a call
    gives for backpropagation is only good until the next one: its memory is used again.
    """

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        net, classes = vocabulary.net, vocabulary.classes
        self.net, self.classes, self.outputs = net, classes, classes + TAIL_CLASSES
        shapes = {
            "emb": (net + TAIL_CLASSES, WIDTH), "wx": (3, WIDTH, WIDTH), "wh": (3, WIDTH, WIDTH), "b": (3, 1, WIDTH),
            "wc": (WIDTH + 1, self.outputs), "wo": (classes, WIDTH + 1, CLASS_WORDS),
        }
        self.flat = np.zeros(sum(map(math.prod, shapes.values())), np.float32) if flat is None else flat.astype(np.float32)
        self.w, self.rooms, at = {}, {}, 0
        for name, shape in shapes.items():
            self.w[name] = self.flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        if flat is None:
            self._fresh(vocabulary)

    def _room(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.rooms or len(self.rooms[name]) < size:
            self.rooms[name] = np.empty(size, np.float32)
        return self.rooms[name][:size].reshape(shape)

    def _fresh(self, vocabulary: Vocabulary) -> None:
        random = np.random.default_rng(SEED)
        self.w["emb"][:] = random.normal(0, 0.1, self.w["emb"].shape)
        for name in ("wx", "wh"):
            self.w[name][:] = random.normal(0, 0.1, (WIDTH, 3, WIDTH)).transpose(1, 0, 2)
        random.normal(0, 0.1, 3 * WIDTH)
        self.w["wc"][:-1] = random.normal(0, 0.1, (WIDTH, self.outputs))
        random.normal(0, 0.1, self.outputs)
        self.w["wo"][:, :-1] = random.normal(0, 0.1, (self.classes, WIDTH, CLASS_WORDS))
        self._unigram(vocabulary)

    def _unigram(self, vocabulary: Vocabulary) -> None:
        shares = np.zeros(self.classes * CLASS_WORDS)
        shares[: self.net] = vocabulary.n[: self.net] + 1
        per_class = shares.reshape(self.classes, CLASS_WORDS)
        with np.errstate(divide="ignore"):
            self.w["wo"][:, -1] = np.maximum(np.log(per_class / per_class.sum(axis=1, keepdims=True)), -30)
        mass = np.concatenate([per_class.sum(axis=1), vocabulary.tail_n + vocabulary.tail_v + 1])
        self.w["wc"][-1] = np.log(mass / mass.sum())

    def read(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict]:
        """States after each step (steps, lanes, WIDTH) and what backpropagation needs."""
        steps, lanes = inputs.shape
        signs = np.array([-1, -1, 1], np.float32)[:, None, None]  # the gates' sums are taken negative, for the exponential
        wx, wh, b = (self.w[name] * signs for name in ("wx", "wh", "b"))
        x = self.w["emb"].take(inputs.ravel(), axis=0, out=self._room("x", inputs.size, WIDTH), mode="clip")
        gates = np.matmul(x, wx, out=self._room("gates", 3, inputs.size, WIDTH))
        gates += b
        gates = gates.reshape(3, steps, lanes, WIDTH)
        before, back, change = self._room("before", steps, lanes, WIDTH), self._room("back", 3, steps, lanes, WIDTH), self._room("change", lanes, WIDTH)
        states = np.empty((steps, lanes, WIDTH), np.float32)
        for t, begun in enumerate(_places_by_step(fresh)):
            was, both, n = before[t], gates[:2, t], gates[2, t]
            was[:] = h
            if len(begun):
                was[begun] = 0
            ahead = np.matmul(was, wh, out=back[:, t])
            both += ahead[:2]
            np.exp(both, out=both)
            both += 1
            np.reciprocal(both, out=both)
            n += np.multiply(both[0], ahead[2], out=change)
            np.tanh(n, out=n)
            np.subtract(was, n, out=change)
            change *= both[1]
            h = np.add(n, change, out=states[t])
        return h, {"x": x, "before": before, "r": gates[0], "z": gates[1], "n": gates[2], "m": back[2], "h": states}

    def _softmax(self, logits: np.ndarray, name: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log chance of the output ``at`` in each row, and the rows' totals; the logits become exponentials.

        Rows are shifted by their maximum only where a state, which lies in [-1, 1], could lead out of range.
        """
        if np.abs(self.w[name]).sum(axis=-2).max() > 80:
            logits -= logits.max(axis=1, keepdims=True)
        logs = logits[np.arange(len(logits)), at]
        np.exp(logits, out=logits)
        totals = logits @ np.ones(logits.shape[1], np.float32)
        return logs - np.log(totals), totals

    def log_chances(self, states: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Natural log chances of targets, without the share inside tail classes; and the parts of both softmaxes, by target."""
        order = np.argsort(targets.astype(np.int16), kind="stable")
        targets = targets[order]
        own = int(np.searchsorted(targets, self.net))
        kind, place = np.divmod(targets[:own], CLASS_WORDS)
        of = np.concatenate([kind, targets[own:] - self.net + self.classes])
        with_one = self._room("with_one", len(order), WIDTH + 1)
        with_one[:, :-1], with_one[:, -1] = states.take(order, axis=0), 1
        soft = np.matmul(with_one, self.w["wc"], out=self._room("soft", len(order), self.outputs))
        logs, totals = self._softmax(soft, "wc", of)
        bounds = np.searchsorted(kind, np.arange(self.classes + 1)).tolist()
        spans = [(c, slice(bounds[c], bounds[c + 1])) for c in range(self.classes) if bounds[c] < bounds[c + 1]]
        chances = self._room("chances", own, CLASS_WORDS)
        for c, span in spans:
            np.matmul(with_one[span], self.w["wo"][c], out=chances[span])
        inside, sums = self._softmax(chances, "wo", place)
        logs[:own] += inside
        out = np.empty_like(logs)
        out[order] = logs
        return out, (order, targets, of, place, with_one, soft, totals, chances, sums, spans)

    def _learn_outputs(self, states: np.ndarray, targets: np.ndarray, speed: "Adagrad") -> np.ndarray:
        """Steps of both softmaxes against the mean log chance; returns the slopes of the states.

        The slope of a softmax is its chances less one at the target; it is left as
        exponentials less their total there, and the states that it meets are divided.
        """
        _, (order, targets, of, place, with_one, soft, totals, chances, sums, spans) = self.log_chances(states, targets)
        scale, rows, own = np.float32(1 / len(order)), np.arange(len(order)), len(place)
        soft[rows, of] -= totals
        share = (scale / totals)[:, None]
        d_sorted = soft @ self.w["wc"][:-1].T
        d_sorted *= share
        slope = _summed_products(with_one * share, soft)
        if own:
            chances[rows[:own], place] -= sums
            share = (scale / sums)[:, None]
            weighed, d_own = with_one[:own] * share, self._room("d_own", own, WIDTH)
            wo, slopes = self.w["wo"][:, :-1].transpose(0, 2, 1).copy(), self._room("slopes", len(spans), WIDTH + 1, CLASS_WORDS)
            for i, (c, span) in enumerate(spans):
                np.matmul(chances[span], wo[c], out=d_own[span])
                np.matmul(weighed[span].T, chances[span], out=slopes[i])
            d_own *= share
            d_sorted[:own] += d_own
            speed.step("wo", slopes, [c for c, _ in spans] if len(spans) < self.classes else slice(None))
        speed.step("wc", slope)
        back = np.empty_like(order)
        back[order] = rows
        return d_sorted.take(back, axis=0)

    def learn(self, inputs: np.ndarray, targets: np.ndarray, weights: np.ndarray, fresh: np.ndarray, h: np.ndarray, speed: "Adagrad") -> np.ndarray:
        """One window of truncated backpropagation over the tokens of weight 1, the others have 0; returns the state after it."""
        after, kept = self.read(inputs, fresh, h)
        states, counted = kept["h"].reshape(-1, WIDTH), np.flatnonzero(weights)
        if len(counted) < len(states):
            d_states = np.zeros_like(states)
            d_states[counted] = self._learn_outputs(states.take(counted, axis=0), targets.ravel()[counted], speed)
        else:
            d_states = self._learn_outputs(states, targets.ravel(), speed)
        d_states = d_states.reshape(kept["h"].shape)
        r, z, n, m, before = (kept[k] for k in ("r", "z", "n", "m", "before"))
        to_back, to_n, rest = self._room("to_back", 3, *z.shape), self._room("to_n", *z.shape), self._room("rest", *z.shape)
        np.multiply(n, n, out=rest)
        np.subtract(1, rest, out=to_n)
        np.subtract(1, z, out=rest)
        to_n *= rest  # from a state's slope to that of its new part; below, to the slopes of what the state before gave
        np.subtract(before, n, out=to_back[1])
        to_back[1] *= z
        to_back[1] *= rest
        np.multiply(to_n, r, out=to_back[2])
        np.subtract(1, r, out=rest)
        np.multiply(to_back[2], rest, out=to_back[0])
        to_back[0] *= m
        wh, through, d_next = self.w["wh"].transpose(0, 2, 1).copy(), self._room("through", 3, *h.shape), np.zeros_like(h)
        begun = _places_by_step(fresh)
        for t in range(len(inputs) - 1, -1, -1):
            d, d_back = d_states[t], to_back[:, t]
            d += d_next
            d_back *= d
            np.matmul(d_back, wh, out=through)
            np.multiply(d, z[t], out=d_next)
            for part in through:
                d_next += part
            if len(begun[t]):
                d_next[begun[t]] = 0
        to_n *= d_states  # by now the slopes of whole states
        d_back = to_back.reshape(3, -1, WIDTH)
        d_ahead, one = [d_back[0], d_back[1], to_n.reshape(-1, WIDTH)], np.ones(inputs.size, np.float32)
        d_x = self._room("rest", inputs.size, WIDTH)
        np.matmul(d_ahead[0], self.w["wx"][0].T, out=d_x)
        for d, w in zip(d_ahead[1:], self.w["wx"][1:], strict=True):
            d_x += np.matmul(d, w.T, out=self._room("part", inputs.size, WIDTH))
        speed.step("wh", np.stack([_summed_products(before.reshape(-1, WIDTH), d) for d in d_back]))
        speed.step("wx", np.stack([_summed_products(kept["x"], d) for d in d_ahead]))
        speed.step("b", np.stack([one @ d for d in d_ahead])[:, None])
        often = np.bincount(inputs.ravel(), minlength=len(self.w["emb"]))
        met = np.flatnonzero(often)
        which = (np.cumsum(often > 0) - 1)[inputs.ravel()]
        summed = np.stack([np.bincount(which, d_x[:, j]) for j in range(WIDTH)], axis=1)
        speed.step("emb", summed.astype(np.float32), met)
        return after


def _summed_products(left: np.ndarray, right: np.ndarray, rows: int = 512) -> np.ndarray:
    """left.T @ right, by pieces that stay in the cache."""
    return sum(left[i : i + rows].T @ right[i : i + rows] for i in range(0, len(left), rows))


def _places_by_step(marks: np.ndarray) -> list[np.ndarray]:
    """For each row the places that are marked."""
    row, place = np.nonzero(marks)
    bounds = np.searchsorted(row, np.arange(len(marks) + 1)).tolist()
    return [place[a:b] for a, b in zip(bounds, bounds[1:])]


class Adagrad:
    def __init__(self, network: Network, rate: float = RATE):
        self.network, self.rate = network, rate
        self.squares = {k: np.full_like(v, 1e-4) for k, v in network.w.items()}

    def step(self, name: str, gradient: np.ndarray, at: object = slice(None)) -> None:
        self.squares[name][at] += gradient * gradient
        self.network.w[name][at] -= self.rate * gradient / np.sqrt(self.squares[name][at])


class Lanes:
    """Documents' symbols dealt to lanes of about equal length, one lane behind the other in flat arrays.

    Memory is that of the symbols, however much longer than the others one document is.
    """

    def __init__(self, documents: list[np.ndarray], most: int = LANES):
        self.count = min(most, len(documents))
        loads, dealt = [(0, i) for i in range(self.count)], [[] for _ in range(self.count)]
        heapify(loads)
        for d in sorted(range(len(documents)), key=lambda i: -len(documents[i])):
            load, lane = loads[0]
            dealt[lane].append(d)
            heapreplace(loads, (load + len(documents[d]), lane))
        dealt.sort(key=lambda own: -sum(len(documents[d]) for d in own))  # lanes end from the last to the first
        self.loads = np.array([sum(len(documents[d]) for d in own) for own in dealt])
        self.begins = np.cumsum(self.loads) - self.loads
        order = [d for own in dealt for d in own]
        sizes = np.array([len(documents[d]) for d in order])
        self.targets = np.concatenate([documents[d] for d in order]).astype(np.int32)
        self.document = np.repeat(np.array(order, np.int32), sizes)
        self.fresh = np.zeros(len(self.targets), bool)
        self.fresh[np.cumsum(sizes) - sizes] = True
        self.inputs = np.zeros_like(self.targets)  # the end token, symbol 0, stands before a document
        self.inputs[1:] = self.targets[:-1]
        self.inputs[self.fresh] = 0

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(inputs, targets, documents, fresh) with steps first, of the lanes that have not ended.

        A window has STEPS steps, and up to MOST_STEPS where few lanes are left; behind a
        lane's end the document is -1.
        """
        s = 0
        while live := int((self.loads > s).sum()):
            steps = int(min(max(STEPS, STEPS * self.count // live), MOST_STEPS, self.loads[0] - s))
            at = np.arange(s, s + steps)[:, None]
            ended = at >= self.loads[None, :live]
            at = np.where(ended, 0, at + self.begins[None, :live])
            yield self.inputs[at], np.where(ended, 0, self.targets[at]), np.where(ended, -1, self.document[at]), self.fresh[at] & ~ended
            s += steps


def _encoded(texts: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts: distinct words, the end token last; their symbols and places; each token's number among them, and the texts' offsets."""
    for _, _, data, bounds in text_slices(texts, SLICE):
        words, numbers, offsets = split_words(data, bounds)
        offsets += np.arange(len(offsets))
        tokens = np.empty(offsets[-1], np.int64)
        word = np.ones(len(tokens), bool)
        word[offsets[1:] - 1] = False
        tokens[word], tokens[~word] = numbers, len(words)
        yield words, *vocabulary.symbols([*words.to_pylist(), END]), tokens, offsets


def _by_text(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    bounds = offsets.tolist()
    return [values[a:b] for a, b in zip(bounds, bounds[1:])]


def _trainer(vocabulary, flat) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, network, tokens = vocabulary.value, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if network is None:
                network = Network(known, flat.value)
                speed = Adagrad(network)
            lanes = Lanes([one for _, symbol, _, tokens, offsets in _encoded(batch["text"], known) for one in _by_text(symbol[tokens], offsets)])
            h = np.zeros((lanes.count, WIDTH), np.float32)
            for inputs, targets, document, fresh in lanes.windows():
                h = network.learn(inputs, targets, (document >= 0).astype(np.float32), fresh, h[: inputs.shape[1]], speed)
            tokens += len(lanes.targets)
        if network is not None:
            yield _weights_row(network.flat.astype(float) * tokens, tokens)

    return train


def _weights_row(summed: np.ndarray, tokens: int) -> pa.RecordBatch:
    return pa.record_batch({"weights": pa.array([summed.astype(np.float32).tobytes()], pa.binary()), "tokens": pa.array([tokens], pa.int64())})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, tokens = None, 0
    for batch in batches:
        for weights, n in zip(batch["weights"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
            summed = np.frombuffer(weights, np.float32).astype(float)
            total, tokens = summed if total is None else total + summed, tokens + n
    if total is not None:
        yield _weights_row(total, tokens)


def train(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Weights after one pass over the documents, in rounds with averaging."""
    spark = docs.sparkSession
    network, shared = Network(vocabulary), spark.sparkContext.broadcast(vocabulary)
    parts = spark.sparkContext.defaultParallelism
    tasks = docs.rdd.getNumPartitions()
    part, first = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(sum(ROUND_SHARES))), 0
    for share in ROUND_SHARES:
        flat = spark.sparkContext.broadcast(network.flat)
        own = docs.where((part >= first) & (part < first + share)).select("text")
        fewest = max(parts, math.ceil(tasks * share / max(ROUND_SHARES)))  # short rounds take longer parts: the longest text of a task keeps few lanes busy
        trained = own.coalesce(min(fewest, tasks)).mapInArrow(_trainer(shared, flat), "weights binary, tokens long")
        for fewer in (parts, math.isqrt(parts) + 1):
            trained = trained.repartition(fewer).mapInArrow(_add, "weights binary, tokens long")
        rows = trained.collect()  # about the root of the number of cores
        tokens = sum(r["tokens"] for r in rows)
        if tokens:
            total = sum(np.frombuffer(r["weights"], np.float32).astype(float) for r in rows)
            network = Network(vocabulary, total / tokens)
        flat.unpersist()
        first += share
    return network.flat


def _scorer(vocabulary, flat, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, uid = vocabulary.value, TaskContext.get().partitionId() << 40
        network = Network(known, flat.value)
        unseen = math.log10(known.tokens + known.distinct + 1)
        inside = np.log10(known.tail_n + known.tail_v + 1)
        count_log = np.append(np.log10(known.n + 1), 0.0)  # the last is for words that are not known here
        seen = np.append(known.n > 0, False)
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols, base, within, n_tokens, n_known, tail_keys, tail_counts, tail_sizes = [], [], [], [], [], [], [], []
            for words, symbol, place, tokens, offsets in _encoded(batch["text"], known):
                symbols += _by_text(symbol[tokens], offsets)
                n_tokens.append(np.diff(offsets))
                n_known.append(np.diff(np.concatenate([[0], np.cumsum(seen[place][tokens])])[offsets]))
                logs, tail = count_log[place], symbol >= known.net
                base.append(sums_between(logs[tokens], offsets) - n_tokens[-1] * unseen)
                logs[tail] -= inside[symbol[tail] - known.net]
                within.append(sums_between(np.where(tail, logs, 0)[tokens], offsets))
                new = np.flatnonzero((place < 0)[tokens])
                text = np.searchsorted(offsets, new, side="right") - 1
                pair, n = np.unique(text * len(place) + tokens[new], return_counts=True)
                tail_keys.append(words.take(pa.array(pair % len(place))).cast(pa.binary()))
                tail_counts.append(n)
                tail_sizes.append(np.bincount(pair // len(place), minlength=len(offsets) - 1))
            n_tokens, n_known, base, within, tail_counts = (np.concatenate(x) for x in (n_tokens, n_known, base, within, tail_counts))
            tail_ends = np.concatenate([[0], np.cumsum(np.concatenate(tail_sizes))])
            lanes, logs = Lanes(symbols), np.zeros(len(symbols))
            h = np.zeros((lanes.count, WIDTH), np.float32)
            for inputs, targets, document, fresh in lanes.windows():
                h, kept = network.read(inputs, fresh, h[: inputs.shape[1]])
                of = document.ravel()
                counted = np.flatnonzero(of >= 0)
                out, _ = network.log_chances(kept["h"].reshape(-1, WIDTH).take(counted, axis=0), targets.ravel()[counted])
                logs += np.bincount(of[counted], out, len(logs))
            parts = pa.StructArray.from_arrays([pa.concat_arrays(tail_keys), pa.array(tail_counts, pa.int64())], ["word", "n"])
            made = {
                "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base": pa.array(base),
                "score": pa.array(logs / math.log(10) + within), "tail": pa.ListArray.from_arrays(pa.array(tail_ends, pa.int32()), parts),
            }
            yield pa.record_batch([*(batch[n] for n in names), pa.array(uid + np.arange(batch.num_rows)), *made.values()], names=[*names, "uid", *made])
            uid += batch.num_rows

    return score


def score_documents(docs: DataFrame, learned: Column, keep: dict[str, Column] | None = None) -> DataFrame:
    """``keep`` columns of each row with n_tokens, n_known, train_tokens, base_score and score;
    ``learned`` tells which rows to learn from."""
    spark, keep = docs.sparkSession, {"doc_id": F.col("doc_id")} if keep is None else keep
    training = docs.where(learned).select("doc_id", "text")
    counts = cut_lineage(training.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    vocabulary = Vocabulary(counts)
    flat = spark.sparkContext.broadcast(train(training, vocabulary))
    shared = spark.sparkContext.broadcast(vocabulary)
    source = docs.select(*[c.alias(n) for n, c in keep.items()], "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    made = "uid long, n_tokens long, n_known long, base double, score double, tail array<struct<word:binary,n:bigint>>"
    scored = cut_lineage(source.mapInArrow(_scorer(shared, flat, list(keep)), f"{fields}, {made}"))
    tails = scored.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", F.col("t.n").alias("tf"))
    met = tails.join(counts, "word").groupBy("uid").agg(F.sum("tf").alias("met"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("gain"))
    joined = scored.join(met, "uid", "left")
    gain = F.coalesce("gain", F.lit(0.0))
    return joined.select(
        *keep, "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"), (F.col("score") + gain).alias("score"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    apart = held_out(F.col("doc_id"), 7, 2)
    return score_documents(docs, ~apart, {"doc_id": F.col("doc_id"), "held_out": apart})
