"""Quality rules: exact counts of a text, and a hashed n-gram logistic regression.

The regression sees word unigrams and bigrams and character trigrams, each hashed
into one table of weights and averaged over the text, so a text's score is a sum
of table look-ups done for a whole Arrow batch at once. It is trained on a bounded
sample of labelled rows; a fold kept apart calibrates scores to probabilities,
which are held against a fixed threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, words_of
from .learning import fit_logistic, fitted, labelled_sample, sigmoid

#: Rows of the labelled sample, table size, probability from which a text is kept.
SAMPLE, BITS, KEEP_FROM = 3000, 18, 0.5
#: Limits of the plain rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
BATCH_CHARS = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    number = dict(zip(dict.fromkeys(words), range(len(words))))
    if len(words) < 4 or len(number) == len(words):
        return 0
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pairs = np.unique(at[:-1] * len(number) + at[1:], return_inverse=True)[1]
    _, which, times = np.unique(pairs[:-1] * len(number) + at[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= again
    return int(inside.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = words_of(text)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(words)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def hashed_grams(texts: list[str]):
    """For each family of n-grams: buckets and the number of the text each belongs to."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    p = points.astype(np.uint64)
    if len(p) > 2:
        inside = np.flatnonzero(owner[2:] == owner[:-2])
        yield _bucket((p[:-2] << np.uint64(42)) + (p[1:-1] << np.uint64(21)) + p[2:] + np.uint64(1))[inside], owner[inside]
    word = ~((points == 32) | ((points >= 9) & (points <= 13)))
    begins = word.copy()
    begins[1:] &= ~word[:-1] | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(begins)
    if len(starts):
        place = np.zeros(len(p), np.int64)
        place[starts[0] :] = np.arange(starts[0], len(p)) - np.repeat(starts, np.diff(np.append(starts, len(p))))
        hashes = np.add.reduceat((p + np.uint64(7)) * _POWERS[place & 4095] * word, starts)
        of = owner[starts]
        yield _bucket(hashes), of
        pair = np.flatnonzero(of[1:] == of[:-1])
        yield _bucket(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:])[pair], of[pair]


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts))
        for buckets, owner in hashed_grams(texts):
            n = np.bincount(owner, minlength=len(texts))
            total += np.bincount(owner, self.weights[buckets], len(texts)) / np.maximum(n, 1)
        return total

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.slope * self.scores(texts) + self.intercept)


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their averaged counts."""
    found = []
    for text in texts:
        parts = [(b, np.full(len(b), 1 / max(len(b), 1), np.float32)) for b, _ in hashed_grams([text])]
        if not parts:
            found.append((np.empty(0, np.int32), np.empty(0, np.float32)))
            continue
        which, at = np.unique(np.concatenate([b for b, _ in parts]), return_inverse=True)
        found.append((which.astype(np.int32), np.bincount(at, np.concatenate([v for _, v in parts])).astype(np.float32)))
    return found


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.5, l2: float = 1e-5) -> Model | None:
    """Train on (label, buckets, values); every fourth row calibrates instead. None without both classes."""
    y = np.array([r[0] for r in rows], float)
    if len(rows) < 8 or y.min() == y.max():
        return None
    fold = np.arange(len(rows)) % 4 == 3
    if len(set(y[~fold])) < 2 or len(set(y[fold])) < 2:
        fold[:] = False
    train = np.flatnonzero(~fold)
    column = np.concatenate([rows[k][1] for k in train])
    value = np.concatenate([rows[k][2] for k in train])
    row = np.repeat(np.arange(len(train), dtype=np.int32), [len(rows[k][1]) for k in train])
    goal = y[train]
    weight = np.where(goal == 1, 0.5 / goal.mean(), 0.5 / (1 - goal.mean()))
    w, bias, squares, bias_square = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(rounds):  # AdaGrad over the whole sample
        p = sigmoid(np.bincount(row, w[column] * value, len(train)) + bias)
        error = (p - goal) * weight / len(train)
        slope = np.bincount(column, value * error[row], 1 << BITS) + l2 * w
        squares += slope**2
        w -= rate * slope / np.sqrt(squares)
        bias_slope = error.sum()
        bias_square += bias_slope**2
        bias -= rate * bias_slope / np.sqrt(bias_square)
    raw = np.array([float(w[c] @ v) for _, c, v in rows])
    apart = np.flatnonzero(fold) if fold.any() else np.arange(len(rows))
    slope, intercept = fit_logistic(raw[apart, None], y[apart], l2=1e-3)
    return Model(w.astype(np.float32), float(slope[0]), intercept)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> Model | None:
    """The model of ``labels.quality``, fitted on at most ``sample`` labelled rows."""
    chosen = labelled_sample(docs, labels, "quality", sample, text_col, id_col)

    def extract(batches):
        for batch in batches:
            found = features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))],
                names=["doc_id", "y", "buckets", "values"],
            )

    kind = dict(chosen.dtypes)["doc_id"]
    found = chosen.select("doc_id", "y", "text").mapInArrow(extract, f"doc_id {kind}, y int, buckets array<int>, values array<float>")

    def learn(table: pa.Table) -> Model | None:
        table = table.sort_by("doc_id")
        return fit([(y, np.asarray(b, np.int32), np.asarray(v, np.float32)) for y, b, v in zip(table["y"].to_pylist(), table["buckets"].to_numpy(), table["values"].to_numpy())])

    return fitted(found, learn)


def _judged(model: Model | None, texts: list[str | None], threshold: float) -> dict[str, np.ndarray]:
    counts = np.array([base_counts(t) for t in texts], np.int64).reshape(len(texts), 5)
    p = np.ones(len(texts))
    if model is not None and texts:
        size = np.cumsum([len(t or "") for t in texts]) // BATCH_CHARS
        p = np.concatenate([model.probabilities([t or "" for t in texts[a:b]]) for a, b in _runs(size)])
    n_words, repeat = counts[:, 0], counts[:, 4]
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    return {"n_words": n_words, "word_chars": counts[:, 1], "n_symbols": counts[:, 2], "n_dup_lines": counts[:, 3], "n_repeat_words": repeat, "base_failed": failed, "probability": p, "kept": ~failed & (p >= threshold)}


def _runs(group: np.ndarray) -> list[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    return list(zip(edges, edges[1:]))


def judge(docs: DataFrame, model: Model | None, threshold: float = KEEP_FROM, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a row of ``docs``: doc_id, the five counts, base_failed, probability, kept.

    Null and empty texts have no words and fail the base rule; without a model
    (no labelled rows of both classes) the probability is 1 and only the base rule
    decides; repeated rows are judged each; an empty table gives no rows; other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            found = _judged(model, batch.column("text").to_pylist(), threshold)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found.values())], names=["doc_id", *found])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = KEEP_FROM, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they were."""
    text = fresh(docs, "text_judged")

    def run(batches):
        for batch in batches:
            found = _judged(model, batch.column(text).to_pylist(), threshold)
            yield batch.filter(pa.array(found["kept"])).select([c for c in batch.schema.names if c != text])

    return docs.withColumn(text, F.col(text_col)).mapInArrow(run, docs.schema)
