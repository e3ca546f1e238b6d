"""Scores of documents by a gated recurrent language model with a class-factored softmax.

* Words are counted over all training documents in the table of distinct words (``words``); the counts give the base
  score. The ``TOP`` most frequent words have outputs of their own, in classes of ``MEMBERS``; every other word is in
  one of ``TAILS`` classes by its last two bytes, in which its share is its smoothed share of the class's tokens. The
  end of a text is a class of one. So every word has a probability, and an unseen one that of its class's spare place.
* The network predicts the class of the next word, and the word in it, from a gated recurrent state. It is trained by
  backpropagation through windows of ``WINDOW`` words, the state carried on from window to window; each task trains a
  copy on every window of its training documents, copies are averaged by the words that they have seen, and again for
  ``ROUNDS`` rounds.
* Documents are scored whole. Those of a task are sorted by length and go side by side through the same windows, the
  state carried on, so a long document costs steps and not memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from herdsignal.llm import common as C, words as W
from herdsignal.session import cut, scratch

#: Words with outputs of their own, words per class, classes of the other words, size of the state.
TOP, MEMBERS, TAILS, STATE = 1536, 32, 64, 24
#: Words per window, documents side by side in scoring and in training, rounds, step size.
WINDOW, LANES, LEARNERS, ROUNDS, STEP = 32, 256, 256, 2, 0.08
#: Added to every count.
ADDED = 0.1
#: Parameters averaged by one task at a time.
FAN_IN = 32
#: Rows whose class shares are held at a time; how far states may move a logit before its row's largest is taken off.
BLOCK, REACH = 256, 80


def splitter(column: pa.Array):
    """Words with their last two bytes, A-Z in lower case, as what stands for them."""
    data, offsets = C.raw(column)
    hashes, row, start, end = C.words(data, offsets)

    def spelled(at: np.ndarray) -> list[bytes]:
        last, many = end[at], end[at] - start[at] > 1
        pair = np.stack([data[last - 1 - many], data[last - 1]], axis=1)  # the last byte twice, if it is the only one
        value = np.where((pair >= 65) & (pair <= 90), pair + 32, pair) @ np.array([1 << 9, 1 << 1]) + many
        values, place = np.unique(value, return_inverse=True)
        known = [(v >> 1).to_bytes(2, "big")[1 - (v & 1) :] for v in values.tolist()]
        return [known[i] for i in place.tolist()]

    return hashes, np.bincount(row, minlength=len(column)).astype(np.int64), spelled


def tail_of(lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Tail classes of endings of at most two bytes, laid out one after the other."""
    ends = np.cumsum(lengths.astype(np.int64))
    wide = np.concatenate([np.zeros(2, np.uint64), data.astype(np.uint64)])
    value = np.where(lengths > 1, wide[ends] << np.uint64(8), np.uint64(0)) + np.where(lengths > 0, wide[ends + 1], np.uint64(0))
    return (C.mixed(value + np.uint64(17)) % np.uint64(TAILS)).astype(np.int64)


@dataclass
class Vocabulary:
    """Training tokens and distinct ones, how often a text ends; the top words; what each tail class holds."""

    tokens: int
    distinct: int
    ends: int
    top: np.ndarray  # hashes, the most frequent first
    top_counts: np.ndarray
    tail_tokens: np.ndarray
    tail_types: np.ndarray

    @property
    def classes(self) -> int:
        return 1 + -(-len(self.top) // MEMBERS) + TAILS

    @property
    def first_tail(self) -> int:
        return 1 + -(-len(self.top) // MEMBERS)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ADDED) / (self.tokens + ADDED * (self.distinct + 1)))

    def in_tail(self, count: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """log10 share of a word in its tail class; what is unseen shares one place."""
        return np.log10((count + ADDED) / (self.tail_tokens[tail] + ADDED * (self.tail_types[tail] + 1)))


def _totals(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each row of a bucket, and of the whole bucket: distinct hashes, counts, tails; place of each word."""
    hashes = [W.unpack(row["d"], np.uint64) for row in rows]
    counts = np.concatenate([W.unpack(row["c"], np.int64) for row in rows])
    every = np.concatenate(hashes)
    values, first, place = np.unique(every, return_index=True, return_inverse=True)
    total = np.zeros(len(values), np.int64)
    np.add.at(total, place, counts)
    lengths, data = (np.concatenate([W.unpack(row[k], kind) for row in rows]) for k, kind in (("a", np.uint32), ("b", np.uint8)))
    return hashes, values, total, tail_of(lengths, data)[first], place


_COUNTED = "tokens binary, types binary, top binary, counts binary, tails binary"


def _counted(tokens, types, values, counts, tails) -> pa.Table:
    """One row: sums by tail class, and the most frequent words, at most TOP."""
    best = np.lexsort((values, -counts))[:TOP]
    best = best[counts[best] > 0]
    parts = (tokens, types, values[best], counts[best], tails[best])
    return pa.table([C.binary([np.ascontiguousarray(x).tobytes()]) for x in parts], [c.split()[0] for c in _COUNTED.split(", ")])


def vocabulary(chunks: DataFrame, buckets: int, train_docs: int) -> Vocabulary:
    """Counts of all training words, and the most frequent ones (at most TOP, whatever the input).

    Each bucket gives one row of bounded size, and rows are put together FAN_IN at a time.
    """

    def run(key, table):
        _, values, total, tail, _ = _totals(table.to_pylist())
        types, tokens = np.bincount(tail[total > 0], minlength=TAILS), np.bincount(tail, total, TAILS).astype(np.int64)
        return _counted(tokens, types, values, total, tail)

    def join(key, table):
        tokens, types, values, counts, tails = ([np.frombuffer(x, np.int64) for x in table.column(i).to_pylist()] for i in range(5))
        return _counted(sum(tokens), sum(types), np.concatenate(values).view(np.uint64), np.concatenate(counts), np.concatenate(tails))

    asked = chunks.where(F.col("bucket") != W.DOCUMENTS).select("bucket", "a", "b", "c", "d").repartition(buckets, "bucket")
    rows = cut(asked.groupBy("bucket").applyInArrow(run, _COUNTED), "counted")
    many = rows.count()
    while many > 1:
        groups = -(-many // FAN_IN)
        joined = rows.withColumn("group", F.expr(f"pmod(xxhash64(tokens, top), {groups})")).groupBy("group")
        rows = cut(joined.applyInArrow(lambda key, table: join(key, table.drop(["group"])), _COUNTED), "counted")
        many = rows.count() if groups > 1 else 1
    found = rows.collect()  # one row of bounded size
    tokens, types, top, counts, tails = [np.frombuffer(bytes(x), np.int64).copy() for x in found[0]] if found else [np.zeros(n, np.int64) for n in (TAILS, TAILS, 0, 0, 0)]
    total, distinct = int(tokens.sum()), int(types.sum())
    np.subtract.at(tokens, tails, counts)
    np.subtract.at(types, tails, 1)
    return Vocabulary(total + train_docs, distinct + (train_docs > 0), train_docs, top.view(np.uint64), counts, tokens, types)


def _teller(known: Vocabulary):
    """Tells a chunk for each of its words: training count, and its code (top word, or TOP + tail class)."""
    order = np.argsort(known.top)
    ranked = known.top[order]

    def run(rows: list[dict]):
        hashes, values, total, tail, place = _totals(rows)
        code = TOP + tail
        if len(ranked):
            at = np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)
            code = np.where(ranked[at] == values, order[at], code)
        at = 0
        for row, mine in zip(rows, hashes, strict=True):
            here = place[at : at + len(mine)]
            yield row, {"a": W.pack(total[here]), "b": W.pack(code[here].astype(np.uint16))}
            at += len(mine)

    return run


def _coded(known: Vocabulary):
    def work(chunk: W.Chunk, told: list[dict]) -> pa.Table:
        count = np.concatenate([np.zeros(0, np.int64), *(W.unpack(r["a"], np.int64) for r in told)])
        code = np.concatenate([np.zeros(0, np.uint16), *(W.unpack(r["b"], np.uint16) for r in told)])
        base = known.base(count)
        tail = np.where(code >= TOP, known.in_tail(count, np.maximum(code.astype(np.int64) - TOP, 0)), 0.0)
        offsets = chunk.offsets
        sums = [np.r_[0.0, np.cumsum(x[chunk.places])] for x in (base, tail, (count > 0).astype(np.float64))]
        base_sum, tail_sum, known_sum = (np.diff(s[offsets]) for s in sums)
        end = float(known.base(np.array([known.ends]))[0])
        codes = code[chunk.places]
        packed = [W.pack(codes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.table(
            [
                chunk.ids,
                pa.array(np.diff(offsets) + 1),
                pa.array(known_sum.astype(np.int64) + (known.ends > 0)),
                pa.array(base_sum + end),
                pa.array(tail_sum),
                pa.array(packed, pa.binary()),
            ],
            ["id", "n_tokens", "n_known", "base_score", "tail_score", "codes"],
        )

    return work


def _softmax(logits: np.ndarray, at: np.ndarray, bounded: bool, learning: bool) -> tuple[np.ndarray | None, np.ndarray]:
    """Row by row: the chosen logit (places ``at`` of all logits), and the sum of the powers that take the logits' place;
    if ``learning``, no logit, and the powers less that sum at the chosen place. ``bounded``: no logit is so far from its
    row's largest that powers could leave the range of the numbers."""
    if not bounded:
        logits -= logits.max(1, keepdims=True)
    flat = logits.reshape(-1)
    chosen = None if learning else flat[at]
    np.exp(logits, out=logits)
    total = logits @ _ONES[: logits.shape[1]]
    if learning:
        flat[at] -= total
    return chosen, total


_ONES = np.ones(1 << 16, np.float32)


def _sums(codes: np.ndarray, rows: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, and for each the sum of its rows; ``space`` takes the rows in order of codes."""
    codes = codes.astype(np.uint16)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first, _ = C.runs(codes)
    rows = rows.take(order, axis=0, out=space, mode="clip")
    return codes[first], np.add.reduceat(rows.view(np.complex64), first, axis=0).view(np.float32)  # pairs of columns at a time


@dataclass
class _Made:
    """Parameters as the passes read them: inputs with the bias and weights of the state, both negated for the gates;
    the weights by which errors go back; outputs with their biases, less the largest, as a last row; the most that a state
    within 1 can move a logit of the heads and of the members."""

    inputs: np.ndarray
    state: np.ndarray
    state_back: np.ndarray
    heads: np.ndarray
    heads_back: np.ndarray
    members: np.ndarray
    reach: tuple[float, float]


class Network:
    """Parameters and passes of the model; rows of ``inputs`` are codes, the last one begins a text."""

    def __init__(self, known: Vocabulary):
        rng = np.random.default_rng(11)
        self.known = known
        self.groups = known.first_tail - 1
        self.made: _Made | None = None
        self.space: dict[str, np.ndarray] = {}
        self.head_of = self._heads()
        codes = TOP + TAILS + 1
        small = lambda *shape: (rng.standard_normal(shape) * 0.08).astype(np.float32)
        heads = np.zeros(known.classes)
        heads[0] = known.ends
        for g in range(self.groups):
            heads[1 + g] = known.top_counts[g * MEMBERS : (g + 1) * MEMBERS].sum()
        heads[known.first_tail :] = known.tail_tokens
        member = np.full((max(1, self.groups), MEMBERS), -30.0)
        member.reshape(-1)[: len(known.top)] = np.log(known.top_counts + ADDED) if len(known.top) else []
        self.p = {
            "inputs": small(codes, 3 * STATE),
            "state": small(STATE, 3 * STATE),
            "bias": np.zeros(3 * STATE, np.float32),
            "heads": small(STATE, known.classes),
            "head_bias": np.log(heads + 1).astype(np.float32),
            "members": small(max(1, self.groups), STATE, MEMBERS),
            "member_bias": member.astype(np.float32),
        }

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for name, value in self.p.items():
            self.p[name] = flat[at : at + value.size].reshape(value.shape).astype(np.float32)
            at += value.size
        self.made = None
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def ready(self) -> _Made:
        """The parameters as the passes read them, made anew after each step of descent."""
        if self.made is None:
            p, gates = self.p, 2 * STATE
            state, inputs = p["state"].copy(), p["inputs"] + p["bias"]
            for both in (state, inputs):
                np.negative(both[:, :gates], out=both[:, :gates])
            heads = np.concatenate([p["heads"], p["head_bias"][None] - p["head_bias"].max()])
            member_bias = p["member_bias"] - p["member_bias"].max(1, keepdims=True)
            self.made = _Made(
                inputs,
                state,
                np.ascontiguousarray(p["state"].T),
                heads,
                np.ascontiguousarray(p["heads"].T),
                np.concatenate([p["members"], member_bias[:, None]], axis=1),
                (float(np.abs(p["heads"]).sum(0).max()), float(np.abs(p["members"]).sum(1).max())),
            )
        return self.made

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array whose memory the next window uses again: what it holds lasts until then."""
        size = math.prod(shape)
        if name not in self.space or self.space[name].size < size:
            self.space[name] = np.empty(size, np.float32)
        return self.space[name][:size].reshape(shape)

    def forward(self, codes: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each row of codes (steps x lanes), from states ``h``; ``keep`` collects what backward needs. Both
        last until the next call."""
        made = self.ready()
        steps, many = codes.shape
        kept = steps if keep is not None else 1
        states, gates = self.room("states", steps + 1, many, STATE), self.room("gates", kept, 2, many, STATE)
        recalled, news = self.room("recalled", kept, many, STATE), self.room("news", kept, many, STATE)
        both, given = self.room("both", many, 3, STATE), self.room("given", many, 3, STATE)
        states[0] = h
        with np.errstate(over="ignore"):  # a power beyond the numbers closes its gate
            for t, place in enumerate(codes):
                h, out, u, gate, new = states[t], states[t + 1], recalled[t % kept], gates[t % kept], news[t % kept]
                made.inputs.take(place, axis=0, out=given.reshape(many, -1), mode="clip")
                np.matmul(h, made.state, out=both.reshape(many, -1))
                np.add(both[:, :2].transpose(1, 0, 2), given[:, :2].transpose(1, 0, 2), out=gate)
                np.exp(gate, out=gate)
                gate += _ONES[0]
                np.reciprocal(gate, out=gate)
                np.multiply(gate[1], both[:, 2], out=u)
                np.add(u, given[:, 2], out=new)
                np.tanh(new, out=new)
                np.subtract(h, new, out=out)
                out *= gate[0]
                out += new
        if keep is not None:
            keep += [states[:-1], gates, news, recalled]
        return states[1:]

    def _heads(self) -> np.ndarray:
        """Class of each code; the end is -1, at the end."""
        codes = np.arange(TOP + TAILS)
        return np.r_[np.where(codes >= TOP, self.known.first_tail + codes - TOP, 1 + codes // MEMBERS), 0]

    def loss(self, states: np.ndarray, codes: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Natural log-probability of each code after a state (rows); with ``grads`` instead the gradient of its negative sum."""
        made = self.ready()
        learning = grads is not None
        size = max(float(states.max(initial=0)), -float(states.min(initial=0)))
        in_heads, in_members = (r * size < REACH for r in made.reach)
        head = self.head_of[codes]
        score = None if learning else np.empty(len(states), np.float32)
        back = self.room("back", len(states), STATE) if learning else None
        of_heads = np.zeros((STATE + 1, self.known.classes), np.float32)
        places = np.arange(0, BLOCK * self.known.classes, self.known.classes)
        space, wide = self.room("logits", BLOCK, self.known.classes), self.room("wide", BLOCK, STATE + 1)
        wide[:, STATE] = 1
        for at in range(0, len(states), BLOCK):
            span = slice(at, at + BLOCK)
            rows = wide[: len(head[span])]
            rows[:, :STATE] = states[span]
            logits = np.matmul(rows, made.heads, out=space[: len(rows)])
            chosen, total = _softmax(logits, places[: len(rows)] + head[span], in_heads, learning)
            if not learning:
                score[span] = chosen - np.log(total)
            else:
                scale = np.reciprocal(total)[:, None]
                of_heads += (rows * scale).T @ logits
                np.multiply(logits @ made.heads_back, scale, out=back[span])
        own = np.flatnonzero((codes >= 0) & (codes < TOP))
        group = (codes[own] // MEMBERS).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        own, group = own[order], group[order]
        mine, place = self.room("mine", len(own), STATE + 1), codes[own] % MEMBERS
        mine[:, :STATE] = states[own]
        mine[:, STATE] = 1
        spans = [(int(group[at]), slice(at, at + many)) for at, many in zip(*(x.tolist() for x in C.runs(group)), strict=True)]
        member = self.room("member", len(own), MEMBERS)
        for g, span in spans:
            np.matmul(mine[span], made.members[g], out=member[span])
        chosen, total = _softmax(member, np.arange(0, member.size, MEMBERS) + place, in_members, learning)
        if not learning:
            score[own] += chosen - np.log(total)
        else:
            scale = np.reciprocal(total)[:, None]
            mine *= scale
            errors = self.room("errors", len(own), STATE)
            of_members = self.room("of_members", len(spans), STATE + 1, MEMBERS)
            for i, (g, span) in enumerate(spans):
                wrong = member[span]
                np.matmul(mine[span].T, wrong, out=of_members[i])
                np.matmul(wrong, made.members[g, :STATE].T, out=errors[span])
            errors *= scale
            back[own] += errors
            grads["heads"], grads["head_bias"] = of_heads[:STATE], of_heads[STATE]
            grads["groups"] = np.array([g for g, _ in spans], np.int64)
            grads["members"], grads["member_bias"] = of_members[:, :STATE], of_members[:, STATE]
        return score, back

    def learn(self, before: np.ndarray, codes: np.ndarray, here: np.ndarray, h: np.ndarray, sums: dict) -> np.ndarray:
        """One step of descent on a window; ``here`` marks the places that hold a word. Returns the last states."""
        made = self.ready()
        keep: list = []
        states = self.forward(before, h, keep)
        last = states[-1].copy()
        grads: dict = {}
        if here.all():
            _, full = self.loss(states.reshape(-1, STATE), codes.ravel(), grads)
        else:
            flat = np.flatnonzero(here)
            _, back = self.loss(states.reshape(-1, STATE)[flat], codes.ravel()[flat], grads)
            full = self.room("full", here.size, STATE)
            full[:] = 0
            full[flat] = back
        full = full.reshape(states.shape)
        scale = np.float32(1 / max(1, here.shape[1]))
        old, gates, news, u = keep
        error = self.room("error", *before.shape, 3, STATE)
        grads["state"] = np.zeros((STATE, 3 * STATE), np.float32)
        carried, through = np.zeros_like(h), np.empty_like(h)
        some = max(1, 4 * BLOCK // max(1, len(h)))
        for at in range((len(before) - 1) // some * some, -1, -some):
            part = slice(at, at + some)
            gate, new, d, wrong = gates[part], news[part], full[part], error[part]
            # What the error of a state is multiplied by to give those of the gates and of what the reset gate lets
            # through (``slope``), and that of the candidate (``lets``).
            slope = self.room("slope", len(gate), 3, *h.shape)
            shut = np.subtract(_ONES[0], gate, out=self.room("shut", *gate.shape))
            lets = np.multiply(new, new, out=self.room("lets", *new.shape))
            np.subtract(_ONES[0], lets, out=lets)
            lets *= shut[:, 0]
            np.subtract(states[part], new, out=slope[:, 0])
            np.multiply(lets, u[part], out=slope[:, 1])
            slope[:, :2] *= shut
            np.multiply(lets, gate[:, 1], out=slope[:, 2])
            for t in range(len(gate) - 1, -1, -1):
                d[t] += carried
                np.multiply(slope[t], d[t], out=wrong[t].transpose(1, 0, 2))
                np.matmul(wrong[t].reshape(-1, 3 * STATE), made.state_back, out=carried)
                carried += np.multiply(d[t], gate[t, 0], out=through)
            grads["state"] += np.matmul(old[part].transpose(0, 2, 1), wrong.reshape(len(gate), -1, 3 * STATE)).sum(0)
            np.multiply(lets, d, out=wrong[:, :, 2])
        error = error.reshape(-1, 3 * STATE)
        codes_read, rows = _sums(before.ravel(), error, self.room("by_code", *error.shape))
        rows *= scale
        bias = _ONES[: len(rows)] @ rows
        self._step("inputs", codes_read, rows, sums)
        self._step("bias", ..., bias, sums)
        for name in ("state", "heads", "head_bias"):
            self._step(name, ..., grads[name] * scale, sums)
        for name in ("members", "member_bias"):
            self._step(name, grads["groups"], grads[name] * scale, sums)
        self.made = None
        return last

    def _step(self, name: str, where, grad: np.ndarray, sums: dict) -> None:
        """Descent scaled by the squares seen so far."""
        grad.clip(-5, 5, out=grad)
        if name not in sums:
            sums[name] = np.full(self.p[name].shape, 0.05, np.float32)
        seen = sums[name][where] + grad * grad
        sums[name][where] = seen
        np.sqrt(seen, out=seen)
        grad *= np.float32(STEP)
        grad /= seen
        self.p[name][where] -= grad


_BEGIN = TOP + TAILS


def lanes(texts: list[np.ndarray], size: int = WINDOW) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Windows of texts side by side, the longest first: (number, previous codes, codes, which places hold one, lanes).

    A code of -1 is the end of a text. Lanes that have ended are left out of the windows that follow.
    """
    lengths = np.array([len(t) + 1 for t in texts])
    begins = np.cumsum(lengths) - lengths
    flat = np.full(int(lengths.sum()), -1, np.int32)
    for begin, text in zip(begins.tolist(), texts, strict=True):
        flat[begin : begin + len(text)] = text
    for number in range(-(-int(lengths.max(initial=0)) // size)):
        at = number * size
        live = int((lengths > at).sum())
        place = np.arange(at, min(at + size, int(lengths[0])))[:, None]
        here = place < lengths[:live]
        codes = flat.take(begins[:live] + place, mode="clip").astype(np.intp)
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[0] = flat[begins[:live] + at - 1] if number else _BEGIN
        if lengths[live - 1] < at + len(place):  # the shortest ends within the window
            codes[~here] = -2
            before[~here] = _BEGIN
        yield number, before, codes, here, live


def _side_by_side(batches: Iterator[pa.RecordBatch], columns: list[str], many: int = LANES) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows in groups of ``many``, the longest first, with their codes."""
    rows: list = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            rows.append(row)
            if len(rows) == many:
                yield rows, [W.unpack(r[-1], np.uint16) for r in rows]
                rows = []
    if rows:
        yield rows, [W.unpack(r[-1], np.uint16) for r in rows]


def train(coded: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters of the model, learned from the rows (n_tokens, codes) of ``coded``."""
    spark = coded.sparkSession
    dealt = coded.select("n_tokens", "codes", "id")
    params = Network(known).flat()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((known, params))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, params = shared.value
            net, sums, seen = Network(known).load(params), {}, 0
            for _, texts in _side_by_side(batches, ["n_tokens", "codes"], LEARNERS):
                h = np.zeros((len(texts), STATE), np.float32)
                for _, before, codes, here, live in lanes(texts):
                    h = net.learn(before, codes, here, h[:live], sums)
                    seen += int(here.sum())
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), C.binary([net.flat().astype(np.float32).tobytes()])], ["seen", "params"])

        learned = dealt.repartition(C.tasks(coded), "id").sortWithinPartitions(F.desc("n_tokens"), "id").select("n_tokens", "codes")
        copies = cut(learned.mapInArrow(run, "seen long, params binary"), "copies")
        params = _average(copies, params)
    return params


def _average(copies: DataFrame, start: np.ndarray) -> np.ndarray:
    """The mean of copies by what they have seen, FAN_IN at a time."""

    def mean(key, table):
        seen = np.asarray(table.column("seen"), np.float64)
        every = np.stack([np.frombuffer(p, np.float32) for p in table.column("params").to_pylist()])
        return pa.table([pa.array([int(seen.sum())]), C.binary([(seen @ every / seen.sum()).astype(np.float32).tobytes()])], ["seen", "params"])

    many = copies.count()
    while many > 1:
        groups = -(-many // FAN_IN)
        copies = cut(copies.withColumn("group", F.expr(f"pmod(xxhash64(params), {groups})")).groupBy("group").applyInArrow(mean, "seen long, params binary"), "copies")
        many = copies.count() if groups > 1 else 1
    rows = copies.collect()  # one row of parameters
    return np.frombuffer(bytes(rows[0]["params"]), np.float32) if rows else start


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, params = shared.value
        net = Network(known).load(params)
        names = ["id", "mark", "n_tokens", "n_known", "base_score", "tail_score"]
        for rows, texts in _side_by_side(batches, [*names, "codes"]):
            total = np.zeros(len(rows))
            h = np.zeros((len(rows), STATE), np.float32)
            for _, before, codes, here, live in lanes(texts):
                states = net.forward(before, h[:live])
                h = states[-1]
                if here.all():
                    score, _ = net.loss(states.reshape(-1, STATE), codes.ravel())
                    total[:live] += score.reshape(here.shape).sum(0, dtype=np.float64)
                else:
                    flat = np.flatnonzero(here)
                    score, _ = net.loss(states.reshape(-1, STATE)[flat], codes.ravel()[flat])
                    total[:live] += np.bincount(flat % live, score, live)
            score = total / math.log(10) + np.array([r[5] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((None, pa.bool_(), pa.int64(), pa.int64(), pa.float64()))), pa.array(score)], [*names[:5], "score"]
            )

    return run


def score(docs: DataFrame, train_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, trained (the value of the boolean column ``train_col``), n_tokens, n_known,
    train_tokens, base_score, score (both log10 probabilities of the whole text).

    Tokens are the words (runs of non-white bytes, A-Z in lower case) and one end per text; null texts are empty and
    have the end only. Counts and network learn from rows whose ``train_col`` is true (null is false). Without any,
    every word is unseen and the network stays as it begins. Ids must not be null to be told apart, but may be
    repeated: each row is scored. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    buckets = C.tasks(docs)
    rows = C.only(docs, id=id_col, text=text_col, mark=train_col).withColumn("mark", F.coalesce("mark", F.lit(False)))
    kind = dict(rows.dtypes)["id"]
    # The id travels with its mark, so that both come back with the chunk.
    tagged = rows.select(F.to_json(F.struct("id", "mark")).alias("id"), "text", "mark")
    schema = "id string, n_tokens long, n_known long, base_score double, tail_score double, codes binary"
    with scratch() as tables:
        chunks = cut(W.split(tagged, splitter, buckets, marked=True), "chunks")
        known = vocabulary(chunks, buckets, rows.where("mark").count())
        told = W.answer(chunks, _teller(known), buckets)
        coded = W.finish(chunks, told, _coded(known), schema)
        coded = cut(coded.withColumn("tag", F.from_json("id", f"id {kind}, mark boolean")).select("tag.id", "tag.mark", *[c.split()[0] for c in schema.split(", ")[1:]]), "coded")
        shared = spark.sparkContext.broadcast((known, train(coded.where("mark"), known)))
        tables.keep(coded)
    dealt = coded.repartition(buckets, F.xxhash64("id")).sortWithinPartitions(F.desc("n_tokens"), "id")
    scored = dealt.mapInArrow(_scores(shared), f"id {kind}, mark boolean, n_tokens long, n_known long, base_score double, score double")
    columns = [F.col("id").alias(id_col), F.col("mark").alias("trained"), "n_tokens", "n_known"]
    return scored.select(*columns, F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", "score")
