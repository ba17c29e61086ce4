"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each step of the network is a word, given as a word vector and the mean of the vectors of
its character trigrams.  It is trained with numpy on windows of labelled documents; a
document's score is the highest of all its overlapping windows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.llm.common import held_out, map_rows, small_batches
from reelgauge.llm.sampling import labelled_sample

#: Bounds of the fitted sample: documents of each label, characters of a document.
PER_LABEL, MAX_CHARS = 1000, 20_000
#: Words of a window, and from one window to the next: any run of half a window lies whole in one.
WINDOW, STRIDE = 32, 16
#: Words with a vector of their own (the rest share one), and documents each must be in.
MAX_WORDS, LEAST_DOCUMENTS = 40_000, 4
#: Width of word vectors, buckets and width of trigram vectors, width of states and attention.
WORD_WIDTH, GRAM_BITS, GRAM_WIDTH, HIDDEN, ATTENTION = 8, 13, 6, 8, 8
EPOCHS, BATCH, SEED = 6, 128, 5
#: Share of words that training hides, so that trigrams have to speak too.
HIDDEN_WORDS = 0.3
#: From this score on a document counts as toxic.
THRESHOLD = 0.7
#: Characters turned into words at once, and windows run at once.
BLOCK_CHARS, BLOCK_WINDOWS = 2_000_000, 2048

_INPUT = WORD_WIDTH + GRAM_WIDTH
_POWERS = np.cumprod(np.full(64, 0x9E3779B1, np.uint32), dtype=np.uint32)


@lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    """Which code points are letters or digits."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    """Words of several texts: hash, text, and the trigram buckets behind each."""

    word: np.ndarray
    text: np.ndarray
    gram: np.ndarray
    first: np.ndarray  # of a word's trigrams


def words_of(texts: list[str]) -> Words:
    """Split texts into lower-case words; a text without letters and digits has none."""
    parts = [t.lower() + "\n" for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _word_characters()[points]
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none)
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) > 1
    first = np.flatnonzero(new)
    letters = points[at].astype(np.uint32)
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
    word = np.add.reduceat(letters * _POWERS[place & 63], first, dtype=np.uint32)
    word = (word ^ (word >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    gram = letters * np.uint32(0xD8163841)
    joined = ~new[1:]
    gram[1:] += letters[:-1] * joined * np.uint32(0x8DA6B343)
    gram[:-1] += letters[1:] * joined * np.uint32(0xCB1AB31F)
    gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x9E3779B1)
    ends = np.cumsum([len(p) for p in parts])
    return Words(
        word, np.searchsorted(ends, at[first], side="right"),
        (gram >> np.uint32(32 - GRAM_BITS)).astype(np.int32), first,
    )


def windows_of(text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of every window; they overlap and leave no word out."""
    counts = np.bincount(text, minlength=n_texts)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    number = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(n_texts), number)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    begin = rank * STRIDE
    return starts[owner] + begin, np.minimum(counts[owner] - begin, WINDOW), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """The weights, by name."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    known: np.ndarray | None = None  # hashes of the words with a vector of their own, ascending

    @staticmethod
    def fresh(known: np.ndarray, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        h = HIDDEN
        return Network(known=known, p={
            "word": draw(len(known) + 1, WORD_WIDTH, scale=0.02),
            "gram": draw(1 << GRAM_BITS, GRAM_WIDTH, scale=0.05),
            "wx": draw(_INPUT, 6 * h, scale=0.3),
            "b": np.zeros(6 * h, np.float32),
            "wh0": draw(h, 3 * h, scale=0.3), "wh1": draw(h, 3 * h, scale=0.3),
            "wa": draw(2 * h, ATTENTION, scale=0.3), "va": draw(ATTENTION, scale=0.3),
            "wo": draw(2 * h, scale=0.3), "bo": np.full(1, -2, np.float32),
        })

    def numbers(self, w: Words) -> np.ndarray:
        """Number of each word; the last one stands for all words without a vector."""
        if not len(self.known):
            return np.zeros(len(w.word), np.int32)
        near = np.minimum(np.searchsorted(self.known, w.word), len(self.known) - 1)
        return np.where(self.known[near] == w.word, near, len(self.known)).astype(np.int32)

    def inputs(self, w: Words, numbers: np.ndarray | None = None) -> np.ndarray:
        """Word vector and mean trigram vector of every word."""
        numbers = self.numbers(w) if numbers is None else numbers
        sizes = np.diff(np.append(w.first, len(w.gram))).astype(np.float32)
        grams = np.add.reduceat(self.p["gram"][w.gram], w.first, axis=0) / sizes[:, None]
        return np.concatenate([self.p["word"][numbers], grams], 1)

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Probability of each window (time first), with what training needs if asked for."""
        steps, n = mask.shape
        h = HIDDEN
        states = np.zeros((steps, n, 2 * h), np.float32)
        trace = []
        for side in (0, 1):
            state = np.zeros((n, h), np.float32)
            wh = self.p[f"wh{side}"]
            zr, cand = np.ascontiguousarray(wh[:, : 2 * h]), np.ascontiguousarray(wh[:, 2 * h :])
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                g = gates[t, :, side * 3 * h : (side + 1) * 3 * h]
                open_ = _sigmoid(g[:, : 2 * h] + state @ zr)
                z, r = open_[:, :h], open_[:, h:]
                c = np.tanh(g[:, 2 * h :] + (r * state) @ cand)
                new = (state + z * (c - state)) * mask[t][:, None]
                if keep:
                    trace.append((side, t, state, z, r, c))
                state = new
                states[t, :, side * h : (side + 1) * h] = state
        inner = np.tanh(states @ self.p["wa"])
        energy = np.where(mask > 0, inner @ self.p["va"], -1e9)
        share = np.exp(energy - energy.max(0))
        share /= share.sum(0)
        pooled = (share[:, :, None] * states).sum(0)
        chance = _sigmoid(pooled @ self.p["wo"] + self.p["bo"][0])
        return (chance, states, trace, inner, share, pooled) if keep else chance

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray):
        """Loss and its gradients; x: time by window by input."""
        p, h = self.p, HIDDEN
        chance, states, trace, inner, share, pooled = self.run(x @ p["wx"] + p["b"], mask, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        d = (chance - target) * weight / weight.sum()
        g["wo"], g["bo"][0] = pooled.T @ d, d.sum()
        dpool = d[:, None] * p["wo"]
        dstates = share[:, :, None] * dpool
        dshare = (states * dpool).sum(2)
        denergy = share * (dshare - (share * dshare).sum(0))
        g["va"] = denergy.ravel() @ inner.reshape(-1, ATTENTION)
        dinner = denergy[:, :, None] * p["va"] * (1 - inner**2)
        g["wa"] = states.reshape(-1, 2 * h).T @ dinner.reshape(-1, ATTENTION)
        dstates += dinner @ p["wa"].T
        dgates = np.zeros((*mask.shape, 6 * h), np.float32)
        carry = {0: 0, 1: 0}
        for side, t, state, z, r, c in reversed(trace):
            wh = p[f"wh{side}"]
            dnew = (dstates[t, :, side * h : (side + 1) * h] + carry[side]) * mask[t][:, None]
            dc = dnew * z * (1 - c**2)
            dz = dnew * (c - state) * z * (1 - z)
            drs = dc @ wh[:, 2 * h :].T
            dr = drs * state * r * (1 - r)
            dzr = np.concatenate([dz, dr], 1)
            carry[side] = dnew * (1 - z) + drs * r + dzr @ wh[:, : 2 * h].T
            g[f"wh{side}"][:, 2 * h :] += (r * state).T @ dc
            g[f"wh{side}"][:, : 2 * h] += state.T @ dzr
            dgates[t, :, side * 3 * h : (side + 1) * 3 * h] = np.concatenate([dzr, dc], 1)
        g["b"] = dgates.sum((0, 1))
        g["wx"] = x.reshape(-1, _INPUT).T @ dgates.reshape(-1, 6 * h)
        loss = -np.mean(np.log(np.where(target > 0, chance, 1 - chance) + 1e-7))
        return loss, g, dgates @ p["wx"].T


def _gathered(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word number by time and window, and which of them are real."""
    steps = np.arange(WINDOW)[:, None]
    mask = (steps < size).astype(np.float32)
    return np.where(mask > 0, first + steps, 0), mask


def _part(w: Words, begin: int, end: int) -> Words:
    """Words ``begin`` to ``end`` alone."""
    first = w.first[begin:end]
    grams = slice(first[0], w.first[end] if end < len(w.first) else len(w.gram))
    return Words(w.word[begin:end], w.text[begin:end], w.gram[grams], first - first[0])


def window_scores(net: Network, w: Words, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Probability of every window; windows are in the order of their first words.

    Vectors exist for the words of one block of windows at a time.
    """
    out = np.zeros(len(first), np.float32)
    for at in range(0, len(first), BLOCK_WINDOWS):
        part = slice(at, at + BLOCK_WINDOWS)
        begin, end = int(first[part][0]), int((first[part] + size[part]).max())
        gates = net.inputs(_part(w, begin, end)) @ net.p["wx"] + net.p["b"]
        index, mask = _gathered(first[part] - begin, size[part])
        out[part] = net.run(gates[index], mask)
    return out


def score_texts(net: Network, texts: list[str | None]) -> np.ndarray:
    """Highest window of each text; 0 for null texts and those without letters and digits."""
    out = np.zeros(len(texts))
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= BLOCK_CHARS):
            size += len(texts[stop] or "")
            stop += 1
        w = words_of([t or "" for t in texts[at:stop]])
        if len(w.word):
            first, length, owner = windows_of(w.text, stop - at)
            np.maximum.at(out[at:stop], owner, window_scores(net, w, first, length))
        at = stop
    return np.clip(out, 0, 1)


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Train on (text, 0 or 1).

    Labels belong to documents, so a toxic one is learned from its most telling window:
    at first the one with the word of highest odds, then the one the network finds worst.
    A clean one gives its worst window and one at random.
    """
    target = np.array([int(y) for _, y in sample])
    w = words_of([t for t, _ in sample])
    pairs = np.unique(w.text.astype(np.int64) << 32 | w.word.astype(np.int64))
    pairs = pairs >> 32, pairs & 0xFFFFFFFF
    hashes, number, spread = np.unique(pairs[1], return_inverse=True, return_counts=True)
    common = np.lexsort((hashes, -spread))[:MAX_WORDS]
    net = Network.fresh(np.sort(hashes[common[spread[common] >= LEAST_DOCUMENTS]]).astype(np.uint32), seed)
    if len(set(target)) < 2 or not len(w.word):
        net.p["bo"][0] = 4.0 if target.any() else -6.0
        net.p["wo"][:] = 0
        return net
    rng = np.random.default_rng(seed)
    first, size, owner = windows_of(w.text, len(sample))
    in_toxic = np.bincount(number[target[pairs[0]] == 1], minlength=len(hashes))
    in_clean = np.bincount(number[target[pairs[0]] == 0], minlength=len(hashes))
    odds = np.log((in_toxic + 0.5) / (target.sum() + 1)) - np.log((in_clean + 0.5) / ((1 - target).sum() + 1))
    index, mask = _gathered(first, size)
    telling = np.where(mask > 0, odds[np.searchsorted(hashes, w.word)][index], -99).max(0)
    numbers = net.numbers(w)
    # words start with what their odds say
    net.p["word"][:-1, 0] = np.clip(odds[np.searchsorted(hashes, net.known)] / 3, -1, 1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    sizes = np.diff(np.append(w.first, len(w.gram)))
    step = 0
    for epoch in range(epochs):
        if epoch % 2 == 0:
            ranked = window_scores(net, w, first, size) if epoch else telling
        order = np.lexsort((ranked, owner))
        worst = order[np.append(owner[order][1:] != owner[order][:-1], True)]
        other = rng.integers(0, len(first), len(worst))
        other = other[target[owner[other]] == 0]
        chosen = rng.permutation(np.concatenate([worst, other]))
        balance = (target[owner[chosen]] == 0).sum() / max(1, (target[owner[chosen]] == 1).sum())
        for at in range(0, len(chosen), BATCH):
            part = chosen[at : at + BATCH]
            index, mask = _gathered(first[part], size[part])
            used, where = np.unique(index, return_inverse=True)
            where = where.reshape(index.shape)
            begin = np.cumsum(sizes[used]) - sizes[used]
            spans = np.arange(sizes[used].sum()) + np.repeat(w.first[used] - begin, sizes[used])
            own = Words(w.word[used], used, w.gram[spans], begin)
            shown = np.where(rng.random(len(used)) < HIDDEN_WORDS, len(net.known), numbers[used])
            vectors = net.inputs(own, shown)
            y = target[owner[part]].astype(np.float32)
            _, grads, dx = net.gradients(vectors[where], mask, y, np.where(y > 0, min(balance, 3.0), 1.0).astype(np.float32))
            dx = (dx * mask[:, :, None]).reshape(-1, _INPUT)
            per_word = np.stack([np.bincount(where.ravel(), dx[:, i], len(used)) for i in range(_INPUT)], 1)
            behind = np.repeat(per_word[:, WORD_WIDTH:] / sizes[used][:, None], sizes[used], axis=0)
            grads["word"] = np.stack([np.bincount(shown, per_word[:, i], len(net.p["word"])) for i in range(WORD_WIDTH)], 1)
            grads["gram"] = np.stack([np.bincount(own.gram, behind[:, i], 1 << GRAM_BITS) for i in range(GRAM_WIDTH)], 1)
            step += 1
            for k, grad in grads.items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                rate = 0.02 / (1 + epoch / 4)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            net.p["word"] *= 0.9995
    return net


def fit_documents(docs: DataFrame, labels: DataFrame) -> Network:
    """Train on a bounded sample of labelled documents that are not held out."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    return fit(labelled_sample(docs, known, PER_LABEL, 2, MAX_CHARS))


def score_documents(docs: DataFrame, net: Network, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """``keep``, score of every whole text; repeated rows are repeated, no row moves.

    Null texts and those without a letter or digit score 0.  Other columns are ignored.
    """
    kind = docs.schema[keep].dataType.simpleString()

    def make():
        return lambda batch: {keep: batch.column(0), "score": score_texts(net, batch.column(1).to_pylist())}

    return map_rows(docs.select(keep, text), f"`{keep}` {kind}, score double", make)


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_documents(docs, fit_documents(docs, labels))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, net: Network, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored under the threshold, with all their columns, in place."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            scores = score_texts(net, batch.column(place).to_pylist())
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
