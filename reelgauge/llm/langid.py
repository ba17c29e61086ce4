"""Language identification by string kernels.

The kernel of two texts is a blended spectrum: for each n, the share of common n-grams
among those present, normalised and summed.  Nyström landmarks turn it into features
for one-versus-rest kernel ridge regression, and texts are scored in batches as matrix
products: presence of n-grams, times landmarks, times weights.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.llm.common import held_out, map_rows, small_batches
from reelgauge.llm.sampling import labelled_sample

#: Bounds of the fitted sample: languages (more are an error), documents and landmarks of each, characters of a document.
MAX_LANGUAGES, PER_LANGUAGE, LANDMARKS, MAX_CHARS = 256, 160, 24, 20_000
#: Lengths of n-grams, characters told apart, n-grams kept of each length.
NGRAMS, ALPHABET, MAX_GRAMS = (1, 2, 3), 160, 12_000
RIDGE = 1e-2
#: Texts multiplied at once, and characters among them.
BLOCK, BLOCK_CHARS = 64, 1_000_000
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Landmark n-grams by length, landmarks as presence vectors, weights."""

    languages: list[str]
    alphabet: str
    grams: dict[int, np.ndarray]  # codes of the n-grams, ascending
    landmarks: dict[int, np.ndarray]  # n-gram by landmark, unit columns
    weights: np.ndarray  # landmark by language
    bias: np.ndarray
    sharpness: float = 8.0


def _codes(texts: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every character (0: none of the alphabet) and its text; texts are kept apart."""
    lowered = [t.lower() + "\x00" for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    return alphabet[np.minimum(points, len(alphabet) - 1)], rows


def _gram_codes(classes: np.ndarray, n: int, base: int) -> np.ndarray:
    out = classes[: max(len(classes) - n + 1, 0)].astype(np.int32)
    for k in range(1, n):
        out = out * base + classes[k : len(classes) - n + 1 + k]
    return out


class _Scorer:
    """A model with its lookup tables, built once per task."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.base = len(model.alphabet) + 2
        self.alphabet = _alphabet_table(model.alphabet)
        self.tables = {}
        for n, codes in model.grams.items():
            table = np.full(self.base**n, len(codes), np.int32)  # the last column holds the rest
            table[codes] = np.arange(len(codes), dtype=np.int32)
            self.tables[n] = table

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel of each text with each landmark."""
        out = np.zeros((len(texts), self.model.weights.shape[0]), np.float32)
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and stop - at < BLOCK and (stop == at or size + len(texts[stop]) < BLOCK_CHARS):
                size += len(texts[stop])
                stop += 1
            classes, rows = _codes(texts[at:stop], self.alphabet)
            for n, table in self.tables.items():
                present = np.zeros((stop - at, len(self.model.grams[n]) + 1), np.float32)
                grams = table[_gram_codes(classes, n, self.base)]
                present[rows[: len(grams)], grams] = 1
                present = present[:, :-1]
                norm = np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
                out[at:stop] += (present / norm) @ self.model.landmarks[n]
            at = stop
        return out / len(self.tables)

    def scores(self, texts: list[str]) -> np.ndarray:
        """One share per language, summing to 1."""
        margin = (self.kernel(texts) @ self.model.weights + self.model.bias) * self.model.sharpness
        grown = np.exp(margin - margin.max(1, keepdims=True))
        return grown / grown.sum(1, keepdims=True)


def _alphabet_table(alphabet: str) -> np.ndarray:
    """Class by code point: 0 ends a text, 1 is any other character."""
    table = np.ones(max([0, *map(ord, alphabet)]) + 2, np.uint8)
    table[0] = 0
    for i, c in enumerate(alphabet):
        table[ord(c)] = i + 2
    return table


def fit(sample: list[tuple[str, str]], ridge: float = RIDGE) -> LanguageModel | None:
    """Fit on (text, language); the first texts of each language are its landmarks."""
    languages = sorted({lang for _, lang in sample})
    if not languages:
        return None
    seen: Counter = Counter()
    marks = []
    for text, lang in sample:
        if seen[lang] < LANDMARKS:
            marks.append(text)
        seen[lang] += 1
    letters = Counter(c for t in marks for c in set(t.lower()) if c != "\x00")
    alphabet = "".join(c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET])
    base, table = len(alphabet) + 2, _alphabet_table(alphabet)
    grams, landmarks = {}, {}
    for n in NGRAMS:
        own = [np.unique(_gram_codes(_codes([t], table)[0], n, base)) for t in marks]
        own = [g[(g % base) > 0] for g in own]  # none that runs over the end
        codes, counts = np.unique(np.concatenate(own), return_counts=True)
        codes = np.sort(codes[np.lexsort((codes, -counts))[:MAX_GRAMS]])
        z = np.stack([np.isin(codes, g) for g in own], 1).astype(np.float32)
        grams[n], landmarks[n] = codes, z / np.sqrt(np.maximum(z.sum(0, keepdims=True), 1))
    blank = np.zeros((len(marks), len(languages)), np.float32)
    model = LanguageModel(languages, alphabet, grams, landmarks, blank, np.zeros(len(languages), np.float32))
    scorer = _Scorer(model)
    mm = scorer.kernel(marks).astype(np.float64)
    values, vectors = np.linalg.eigh((mm + mm.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # the Nyström features: k(x, landmarks) @ root
    features = scorer.kernel([t for t, _ in sample]).astype(np.float64) @ root
    index = {lang: i for i, lang in enumerate(languages)}
    targets = -np.ones((len(sample), len(languages)))
    targets[np.arange(len(sample)), [index[lang] for _, lang in sample]] = 1
    weight = np.array([1 / seen[lang] for _, lang in sample])
    weight /= weight.sum()
    middle, level = weight @ features, weight @ targets
    x = features - middle
    solved = np.linalg.solve((x * weight[:, None]).T @ x + ridge * np.eye(x.shape[1]) / len(sample), (x * weight[:, None]).T @ (targets - level))
    model.weights = (root @ solved).astype(np.float32)
    model.bias = (level - middle @ solved).astype(np.float32)
    return model


def fit_documents(docs: DataFrame, label: str = "lang") -> LanguageModel | None:
    """Fit on a bounded sample of the documents that are not held out; None without any.

    Every label is learned; more than ``MAX_LANGUAGES`` raise a ValueError.
    """
    known = docs.select("doc_id", F.col(label).alias("label"))
    return fit(labelled_sample(docs, known, PER_LANGUAGE, MAX_LANGUAGES, MAX_CHARS))


def predictions(scorer: _Scorer | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and share of each text."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    able = [i for i, t in enumerate(texts) if scorer and t and any(map(str.isalpha, t))]
    if able:
        shares = scorer.scores([texts[i] for i in able])
        for i, best, share in zip(able, shares.argmax(1), shares.max(1), strict=True):
            names[i], scores[i] = scorer.model.languages[best], float(share)
    return names, scores


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """``keep``, lang_pred, score of every whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if
    there is no model.  Repeated rows are repeated, other columns are ignored, no row moves.
    """
    kind = docs.schema[keep].dataType.simpleString()

    def make():
        scorer = _Scorer(model) if model else None

        def run(batch):
            names, scores = predictions(scorer, batch.column(1).to_pylist())
            return {keep: batch.column(0), "lang_pred": names, "score": scores}

        return run

    return map_rows(docs.select(keep, text), f"`{keep}` {kind}, lang_pred string, score double", make)


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, by a model of the documents not held out."""
    found = identify(docs, fit_documents(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("score"))


def keep_known(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that have a letter, with all their columns, in place.

    With or without a model these are the same: a model names a language for each of them.
    """
    small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches):
        scorer = _Scorer(model) if model else None
        for batch in batches:
            texts = batch.column(place).to_pylist()
            if scorer:
                known = [n != UNKNOWN for n in predictions(scorer, texts)[0]]
            else:
                known = [any(map(str.isalpha, t or "")) for t in texts]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
