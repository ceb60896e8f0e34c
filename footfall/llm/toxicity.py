"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word is a run of letters, digits and bytes of other scripts, in small letters. Its input is an embedding of the word
(by hash) next to the mean embedding of its character triples (by hash). Windows of ``WIDTH`` words overlap by half and
cover the whole text; two recurrences read a window in both directions, attention weighs its words, and a logistic unit
scores it. A document's logit is that of its worst window, scaled by a logistic fit over the training documents.

Training sees document labels only: in each epoch every document contributes its currently worst window, and clean ones a
random window too. Word embeddings start with the log-odds of their documents' labels in one component.

Defined cases: null texts and texts without words score the probability of the empty window set, the fit's value for the
lowest training logit; without training rows of both classes every text scores 0. Repeated rows each get a row.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import labelled, spans
from footfall.llm.book import small_batches

LABELLED = 3000  # rows of the sample, half of each class
TRAIN_BYTES = 32_768  # longest text of the sample
WIDTH, STRIDE = 48, 24
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 13
EPOCHS = 6
BLOCK = 4096  # windows run through the network at once
CHUNK = 1 << 20


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Small-letter bytes with everything between words made spaces; starts, ends and counts of words."""
    plain = spans.plain(data)
    return plain, *spans.words(plain, offsets)


def vocabulary(plain: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Different words: hash rows, character-triple rows with their counts, and each occurrence's word."""
    keys, first, back = np.unique(spans.xxh64(plain, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    sizes = e - s  # a triple starts one byte before each byte; the text's ends count as spaces
    owner = spans.owners(sizes)
    at = s[owner] + np.arange(sizes.sum()) - (np.cumsum(sizes) - sizes)[owner]
    around = np.concatenate([[np.uint8(0x20)], plain, [np.uint8(0x20)]]).astype(np.uint32)
    left = np.where(at == s[owner], 0x20, around[at])
    right = np.where(at + 1 == e[owner], 0x20, around[at + 2])
    triples = ((left * 65599 + around[at + 1]) * 65599 + right) % np.uint32(2**31 - 1) % CHAR_ROWS
    return (keys % np.uint64(WORD_ROWS)).astype(np.int64), triples.astype(np.int64), sizes, back


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and row of all windows."""
    number = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WIDTH) // STRIDE)), 0)
    owner = spans.owners(number)
    inner = np.arange(number.sum()) - (np.cumsum(number) - number)[owner]
    first = (np.cumsum(counts) - counts)[owner] + STRIDE * inner
    return first, np.minimum(WIDTH, counts[owner] - STRIDE * inner), owner


def _sigmoid(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Weights, and the passes through them."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        inputs, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {"word": normal(WORD_ROWS, WORD_DIM, scale=0.05), "char": normal(CHAR_ROWS, CHAR_DIM, scale=0.1),
                  "att": normal(2 * h, ATTENTION, scale=0.3), "att_v": normal(ATTENTION, scale=0.3),
                  "out": normal(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": normal(inputs, 3 * h, scale=0.3), f"rec_{d}": normal(h, 3 * h, scale=0.3),
                       f"off_{d}": np.zeros(3 * h, np.float32)}
        self.scale, self.shift, self.lowest = 1.0, 0.0, 0.0

    def word_inputs(self, rows, triples, sizes):
        chars = np.add.reduceat(self.p["char"][triples], np.cumsum(sizes) - sizes, axis=0) if len(sizes) else (
            np.zeros((0, CHAR_DIM), np.float32))
        return np.concatenate([self.p["word"][rows], chars / np.maximum(sizes, 1)[:, None].astype(np.float32)], axis=1)

    def _read(self, d, projected, index, mask, keep):
        """Hidden states of one direction, (time, windows, hidden), padding leaves the state as it is."""
        h, steps = HIDDEN, index.shape[0]
        state = np.zeros((index.shape[1], h), np.float32)
        out = np.empty((steps, *state.shape), np.float32)
        past = []
        rec = self.p[f"rec_{d}"]
        for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
            x, m = projected[index[t]], mask[t]
            gates = _sigmoid(x[:, :2 * h] + state @ rec[:, :2 * h])
            update, reset = gates[:, :h], gates[:, h:]
            inner = reset * state
            new = np.tanh(x[:, 2 * h:] + inner @ rec[:, 2 * h:])
            following = state + (m * update) * (new - state)
            if keep:
                past.append((t, state, update, reset, new))
            out[t] = state = following
        return out, past

    def run(self, inputs, index, mask, keep=False):
        """Logits of windows given as word indices (time, windows)."""
        mask3 = mask[:, :, None]
        both, past = [], {}
        for d in "fb":
            projected = inputs @ self.p[f"in_{d}"] + self.p[f"off_{d}"]
            states, past[d] = self._read(d, projected, index, mask3, keep)
            both.append(states)
        states = np.concatenate(both, axis=2)
        hidden = np.tanh(states @ self.p["att"])
        energy = np.where(mask > 0, hidden @ self.p["att_v"], np.float32(-1e9))
        energy = np.exp(energy - energy.max(axis=0))
        weight = energy / energy.sum(axis=0)
        pooled = np.einsum("tw,twh->wh", weight, states)
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return (logits, (states, hidden, weight, pooled, past)) if keep else logits

    def gradients(self, rows, triples, sizes, index, mask, labels):
        """Loss gradients of a batch of windows."""
        p, h = self.p, HIDDEN
        inputs = self.word_inputs(rows, triples, sizes)
        logits, (states, hidden, weight, pooled, past) = self.run(inputs, index, mask, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        d_logit = ((_sigmoid(logits) - labels) / len(labels)).astype(np.float32)
        g["out"], g["bias"][0] = pooled.T @ d_logit, d_logit.sum()
        d_pooled = d_logit[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("wh,twh->tw", d_pooled, states)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att_v"] = np.einsum("tw,twa->a", d_energy, hidden)
        d_hidden = d_energy[:, :, None] * p["att_v"] * (1 - hidden**2)
        g["att"] = np.einsum("twh,twa->ha", states, d_hidden)
        d_states = d_states + d_hidden @ p["att"].T
        d_inputs = np.zeros_like(inputs)
        for n, d in enumerate("fb"):
            rec, d_state = p[f"rec_{d}"], np.zeros((index.shape[1], h), np.float32)
            d_projected = np.zeros((len(inputs), 3 * h), np.float32)
            for t, state, update, reset, new in reversed(past[d]):
                d_state = d_state + d_states[t, :, n * h:(n + 1) * h]
                m = mask[t][:, None]
                d_new = d_state * m * update * (1 - new**2)
                d_update = d_state * m * (new - state) * update * (1 - update)
                inner = reset * state
                d_inner = d_new @ rec[:, 2 * h:].T
                d_reset = d_inner * state * reset * (1 - reset)
                d_gate = np.concatenate([d_update, d_reset], axis=1)
                g[f"rec_{d}"][:, :2 * h] += state.T @ d_gate
                g[f"rec_{d}"][:, 2 * h:] += inner.T @ d_new
                d_all = np.concatenate([d_gate, d_new], axis=1)
                np.add.at(d_projected, index[t], d_all)
                d_state = d_state * (1 - m * update) + d_inner * reset + d_gate @ rec[:, :2 * h].T
            g[f"off_{d}"] = d_projected.sum(axis=0)
            g[f"in_{d}"] = inputs.T @ d_projected
            d_inputs += d_projected @ p[f"in_{d}"].T
        d_char = np.repeat(d_inputs[:, WORD_DIM:] / np.maximum(sizes, 1)[:, None], sizes, axis=0)
        return g, (rows, d_inputs[:, :WORD_DIM]), (triples, d_char)

    def worst(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The logits of all windows, and what they were made from."""
        plain, starts, ends, counts = split(data, offsets)
        rows, triples, sizes, back = vocabulary(plain, starts, ends)
        first, length, owner = windows(counts)
        inputs = self.word_inputs(rows, triples, sizes)
        logits = np.zeros(len(first), np.float32)
        for low in range(0, len(first), BLOCK):
            some = slice(low, low + BLOCK)
            index, mask = _layout(first[some], length[some], back)
            logits[some] = self.run(inputs, index, mask)
        return logits, (rows, triples, sizes, back, first, length, owner)

    def document_logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.lowest, np.float64)
        for low, high in spans.chunks(offsets, CHUNK):
            logits, parts = self.worst(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
            owner = parts[-1]
            if len(owner):
                heads = np.flatnonzero(np.diff(owner, prepend=-1))
                out[low + owner[heads]] = np.maximum.reduceat(logits, heads)
        return out

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.document_logits(data, offsets) + self.shift, -40, 40)))


def _layout(first, length, back):
    """Word indices and mask of windows, (time, windows)."""
    steps = int(length.max(initial=1))
    t = np.arange(steps)[:, None]
    mask = t < length
    return back[np.where(mask, first + t, first)], mask.astype(np.float32)


def _used(rows, triples, sizes, index):
    """The words that a batch of windows has, numbered anew."""
    words, new = np.unique(index, return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    part = sizes[words]
    owner = spans.owners(part)
    at = begin[words][owner] + np.arange(part.sum()) - (np.cumsum(part) - part)[owner]
    return rows[words], triples[at], part, new.reshape(index.shape)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0, rate: float = 0.02, batch: int = 64) -> Network:
    """A network fitted to whole texts with labels 0 and 1."""
    net, rng = Network(seed), np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    if not 0 < labels.sum() < len(labels):
        net.p["bias"][0], net.shift = 0, -40.0
        return net
    data, offsets = spans.text_bytes(pa.array(texts, pa.large_string()))
    plain, starts, ends, counts = split(data, offsets)
    rows, triples, sizes, back = vocabulary(plain, starts, ends)
    first, length, owner = windows(counts)
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    docs = owner[heads]

    seen = np.unique(spans.owners(counts) * WORD_ROWS + rows[back])
    toxic = np.bincount(seen % WORD_ROWS, labels[seen // WORD_ROWS], WORD_ROWS)
    clean = np.bincount(seen % WORD_ROWS, 1 - labels[seen // WORD_ROWS], WORD_ROWS)
    odds = np.log((toxic + 0.5) / (labels.sum() + 1)) - np.log((clean + 0.5) / (len(labels) - labels.sum() + 1))
    net.p["word"][:, 0] = np.where(toxic + clean > 2, odds, 0) * 0.5

    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0

    def adam(name, grad, at=slice(None)):
        m, v = moments[name]
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad**2
        net.p[name][at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)

    def scatter(at, grad, width):
        some, new = np.unique(at, return_inverse=True)
        out = np.stack([np.bincount(new, grad[:, k], len(some)) for k in range(width)], axis=1).astype(np.float32)
        return some, out

    for epoch in range(epochs):
        inputs = net.word_inputs(rows, triples, sizes)
        logits = np.zeros(len(first), np.float32)
        for low in range(0, len(first), BLOCK):
            some = slice(low, low + BLOCK)
            logits[some] = net.run(inputs, *_layout(first[some], length[some], back))
        if epoch == 0:  # before any training the windows are told apart by the words' odds alone
            strength = np.concatenate([[0], np.cumsum(np.maximum(net.p["word"][rows[back], 0], 0) ** 3)])
            logits = strength[first + length] - strength[first]
        order = np.lexsort((logits, owner))
        top = order[np.append(heads[1:], len(owner)) - 1]
        clean_docs = labels[docs] == 0
        extra = (heads + (rng.random(len(heads)) * np.diff(np.append(heads, len(owner)))).astype(np.int64))[clean_docs]
        chosen = np.concatenate([top, extra])
        targets = np.concatenate([labels[docs], np.zeros(len(extra), np.float32)])
        for some in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // batch)):
            step += 1
            index, mask = _layout(first[chosen[some]], length[chosen[some]], back)
            r, c, s, index = _used(rows, triples, sizes, index)
            g, (wr, wg), (cr, cg) = net.gradients(r, c, s, index, mask, targets[some])
            for name, grad in g.items():
                adam(name, np.clip(grad, -1, 1))
            at, grad = scatter(wr, wg, WORD_DIM)
            adam("word", grad, at)
            at, grad = scatter(cr, cg, CHAR_DIM)
            adam("char", grad, at)

    worst = net.document_logits(data, offsets)
    net.lowest = float(worst[docs].min())
    worst[counts == 0] = net.lowest
    x = np.stack([worst, np.ones(len(worst))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps of a logistic fit
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hess, x.T @ (q - labels) + 1e-3 * (w - [1.0, 0.0]))
    net.scale, net.shift = float(w[0]), float(w[1])
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = LABELLED, max_bytes: int = TRAIN_BYTES,
        id_column: str = "doc_id", text: str = "text") -> Network:
    """Train on a bounded sample of labelled rows outside the held-out fold."""
    got = labelled.sample(docs, labels, label, rows, id_column, text, max_bytes).toArrow().sort_by(
        [("id", "ascending"), ("text", "ascending")])
    net = train(got["text"].to_pylist(), got["label"].to_numpy())
    del got
    _release()
    return net


def _release() -> None:
    """Give the memory of the training back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def score(docs: DataFrame, net: Network, threshold: float = 0.5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(net)

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            scores = sent.value.probability(*spans.text_bytes(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    kind = docs.schema[id_column].dataType.simpleString()
    scored = docs.select(F.col(id_column), F.col(text)).mapInArrow(batches, f"doc_id {kind}, score double, predicted int")
    return scored.withColumnRenamed("doc_id", id_column)
