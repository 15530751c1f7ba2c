"""Language identification by interpolated Kneser-Ney character models.

Counting is distributed: tasks count the character four-grams of padded words
over all training rows, one shuffle adds them up, and grouped aggregates derive
the continuation counts of the lower orders; every n-gram of every language is
kept. Small models are loaded: four pairs of sorted hash arrays a language
(discounted probabilities by n-gram, back-off weights by context), looked up by
binary search. Larger ones stay tables on Spark, and the distinct n-grams of the
texts are joined with them. Both ways add the same whole numbers, log-probabilities
in steps of ``1 / STEPS``, so they give the same scores. A text gets the language of
lowest cross-entropy per character; a logistic curve over the distance to the
runner-up turns it into the probability of being right, and texts below one half are
marked as rejected. The curve is fitted on texts that no count has seen.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out
from .learning import fit_logistic, sigmoid

ORDER, DISCOUNT = 4, 0.75
#: Table rows and languages up to which models are loaded (beyond, they are joined); rows that calibrate; score below which a text is rejected.
MOST_LOADED, MOST_LANGUAGES, CALIBRATION, REJECT_BELOW = 1_500_000, 64, 2000, 0.5
#: One in ``FOLD`` texts may calibrate, in languages of at least ``LEAST_ROWS`` rows among the others.
FOLD, LEAST_ROWS = 8, 20
#: Words whose scores a task remembers, and words scored together.
MOST_KEPT, TOGETHER = 300_000, 200_000
#: Steps of one nat in which log-probabilities are added, so that a sum depends neither on its order nor on a logarithm's last bit; digits of a score.
STEPS, DIGITS = 2.0**20, 1e9
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")
_EDGE = "\x01"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(codes: np.ndarray) -> np.ndarray:
    """A one-to-one hash of packed n-grams."""
    h = codes * _MIX
    return h ^ (h >> np.uint64(29))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed four-grams of the letter runs of words, 16 bits a character, and each one's word.

    A letter above U+FFFF counts as its two UTF-16 units, so none are mixed up.
    """
    runs = [_LETTERS.findall(w) for w in words]
    padded = "".join([f"{_EDGE}{_EDGE}{_EDGE}{r}{_EDGE}" for found in runs for r in found])
    p = np.frombuffer(padded.encode("utf-16-le"), np.uint16).astype(np.uint64)
    length = len if len(p) == len(padded) else lambda r: len(r.encode("utf-16-le")) // 2
    owner = np.repeat(np.arange(len(words)), [sum(length(r) + 4 for r in found) for found in runs])
    if not len(p):
        return np.empty(0, np.uint64), owner
    codes = (p[:-3] << np.uint64(48)) | (p[1:-2] << np.uint64(32)) | (p[2:-1] << np.uint64(16)) | p[3:]
    real = (p[3:] != 1) | (p[2:-1] != 1)
    return codes[real], owner[3:][real]


def counted(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, code, n): four-grams of all rows of ``docs`` with text and language."""

    def run(batches):
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words.setdefault(lang, Counter()).update(text.lower().split())
            for lang, found in words.items():
                codes, owner = grams(list(found))
                times = np.fromiter(found.values(), np.int64, len(found))
                distinct, at = np.unique(codes, return_inverse=True)
                n = np.bincount(at, times[owner], len(distinct)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct), pa.string()), pa.array(distinct.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    parts = rows.mapInArrow(run, "lang string, code long, n long")
    return parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def tables(counts: DataFrame) -> DataFrame:
    """(lang, size, part, code, value): for n-grams of each size, discounted probabilities
    (part 0) and the back-off weights of their contexts (part 1)."""
    found = []
    now = counts
    for size in range(ORDER, 0, -1):
        context = F.shiftrightunsigned("code", 16)
        total = now.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        cut = DISCOUNT if size > 1 else 0.0
        probability = now.withColumn("context", context).join(total, ["lang", "context"]).select("lang", F.lit(size).alias("size"), F.lit(0).alias("part"), "code", ((F.col("n") - cut) / F.col("total")).alias("value"))
        found.append(probability)
        if size > 1:
            found.append(total.select("lang", F.lit(size).alias("size"), F.lit(1).alias("part"), F.col("context").alias("code"), (DISCOUNT * F.col("kinds") / F.col("total")).alias("value")))
            shorter = F.col("code").bitwiseAND(F.lit((1 << (16 * (size - 1))) - 1))
            now = now.groupBy("lang", shorter.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return every


def text_grams(rows: DataFrame) -> DataFrame:
    """(key, code, n): the four-grams of rows (key, text)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                found = [np.unique(grams((text or "").lower().split())[0], return_counts=True) for text in batch.column("text").to_pylist()]
                owner = np.repeat(np.arange(len(found)), [len(codes) for codes, _ in found])
                code, n = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(owner)), pa.array(code), pa.array(n)], names=["key", "code", "n"])

    return rows.select("key", "text").mapInArrow(run, "key binary, code long, n long")


def curve(gap: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the probability of being right at a distance."""
    # no distance means no knowledge: one pseudo-row of either kind
    x, y = np.concatenate([gap, [0.0, 0.0]]), np.concatenate([right, [0.0, 1.0]])
    slope, intercept = fit_logistic(x[:, None], y, l2=1e-2)
    return max(float(slope[0]), 0.0), float(intercept)


@dataclass
class Models:
    languages: list[str] = field(default_factory=list)
    #: by language and size: sorted hashes and values of n-grams, and of contexts
    arrays: list[dict[int, tuple]] = field(default_factory=list)
    slope: float = 0.0
    intercept: float = 0.0

    def __post_init__(self) -> None:
        self._forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self._row: dict[str, int] = {}
        self._values = np.zeros((1 << 12, len(self.languages) + 1))

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), other)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], other)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Natural logs for packed four-grams in whole steps, one column a language."""
        out = np.empty((len(codes), len(self.languages)))
        for k, arrays in enumerate(self.arrays):
            p = np.full(len(codes), 1e-6)
            for size in range(1, ORDER + 1):
                code = codes & np.uint64((1 << (16 * size)) - 1)
                keys, values, contexts, weights = arrays[size]
                own = self._look(keys, values, mixed(code), 0.0)
                if size == 1:
                    p = np.maximum(own, p)
                else:
                    p = own + self._look(contexts, weights, mixed(code >> np.uint64(16)), 1.0) * p
            out[:, k] = np.floor(np.log(p) * STEPS + 0.5)
        return out

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20000):
            some = words[at : at + 20000]
            codes, owner = grams(some)
            distinct, back = np.unique(codes, return_inverse=True)
            logs = self.log_probabilities(distinct)[back]
            first = len(self._row)
            while first + len(some) > len(self._values):
                self._values = np.concatenate([self._values, np.zeros_like(self._values)])
            block = self._values[first : first + len(some)]
            for k in range(len(self.languages)):
                block[:, k] = np.bincount(owner, logs[:, k], len(some))
            block[:, -1] = np.bincount(owner, minlength=len(some))
            self._row.update(zip(some, range(first, first + len(some))))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character and language, and the number of characters."""
        total = np.zeros((len(texts), self._values.shape[1]))
        words: list[str] = []
        pieces: list[tuple[int, int]] = []  # (text, words) in order; a long text is in several

        def flush() -> None:
            if len(self._row) > MOST_KEPT:
                self._forget()
            self._learn(sorted(set(words).difference(self._row)))
            if words:
                at = np.fromiter(map(self._row.__getitem__, words), np.int64, len(words))
                owner, lengths = np.array(pieces, np.int64).T
                np.add.at(total, owner, np.add.reduceat(self._values[at], np.cumsum(lengths) - lengths, axis=0))
            words.clear()
            pieces.clear()

        for k, text in enumerate(texts):
            found = (text or "").lower().split()
            for first in range(0, len(found), TOGETHER):
                some = found[first : first + TOGETHER]
                words += some
                pieces.append((k, len(some)))
                if len(words) >= TOGETHER:
                    flush()
        flush()
        n = total[:, -1]
        return -total[:, :-1] / STEPS / np.maximum(n, 1)[:, None], n

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its distance to the runner-up per character, and whether there is any letter."""
        entropy, n = self.entropies(texts)
        if not self.languages:
            return np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
        best = entropy.argmin(axis=1)
        ordered = np.sort(entropy, axis=1)
        gap = ordered[:, 1] - ordered[:, 0] if len(self.languages) > 1 else np.full(len(texts), 1.0)
        return best, gap * np.sqrt(np.maximum(n, 1)), n > 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        best, gap, known = self.margins(texts)
        score = np.where(known, np.floor(sigmoid(self.slope * gap + self.intercept) * DIGITS + 0.5) / DIGITS, 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score

    def calibrate(self, rows: DataFrame) -> None:
        """Fit the curve on rows (lang, text); the margins are taken in tasks, two numbers a row come back."""
        if not self.languages:
            return

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 200):
                    batch = whole.slice(at, 200)
                    best, gap, known = self.margins(batch.column("text").to_pylist())
                    right = [float(self.languages[b] == lang) for b, lang in zip(best, batch.column("lang").to_pylist())]
                    yield pa.RecordBatch.from_arrays([pa.array(gap[known]), pa.array(np.array(right)[known])], names=["gap", "right"])

        found = rows.mapInArrow(run, "gap double, right double").toArrow().sort_by([("gap", "ascending"), ("right", "ascending")])
        if found.num_rows:
            self.slope, self.intercept = curve(found["gap"].to_numpy(), found["right"].to_numpy())


@dataclass
class Joined:
    """Models that stay tables on Spark (``table``: lang, size, part, code, value)."""

    table: DataFrame
    slope: float = 0.0
    intercept: float = 0.0

    def log_probabilities(self, codes: DataFrame) -> DataFrame:
        """(code, lang, steps) of every language for four-grams (code)."""
        languages = [r.lang for r in self.table.select("lang").distinct().collect()]  # a name a language
        found = codes.select("code", F.explode(F.array(*map(F.lit, sorted(languages)))).alias("lang"), F.lit(1e-6).alias("p"))
        for size in range(1, ORDER + 1):
            short = F.col("code").bitwiseAND(F.lit((1 << (16 * size)) - 1 if size < ORDER else -1))
            one = self.table.where(F.col("size") == size)
            own = one.where("part = 0").select("lang", F.col("code").alias("short"), F.col("value").alias("own"))
            found = found.withColumn("short", short).join(own, ["lang", "short"], "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
            if size == 1:
                found = found.select("code", "lang", F.greatest("own", "p").alias("p"))
            else:
                weights = one.where("part = 1").select("lang", F.col("code").alias("context"), F.col("value").alias("weight"))
                found = found.withColumn("context", F.shiftrightunsigned("short", 16)).join(weights, ["lang", "context"], "left")
                found = found.select("code", "lang", (F.col("own") + F.coalesce("weight", F.lit(1.0)) * F.col("p")).alias("p"))
        return found.select("code", "lang", F.floor(F.log("p") * STEPS + 0.5).alias("steps"))

    def margins(self, texts: DataFrame) -> DataFrame:
        """(key, best, gap) as ``Models.margins``, for distinct texts (key, text) with any letter."""
        parts = cut(text_grams(texts))
        logs = self.log_probabilities(parts.select("code").distinct())
        sums = parts.join(logs, "code").groupBy("key", "lang").agg(F.sum(F.col("n") * F.col("steps")).alias("logs"), F.sum("n").alias("n"))
        entropy = F.struct((-F.col("logs") / STEPS / F.col("n")).alias("entropy"), "lang")
        ranked = sums.groupBy("key").agg(F.sort_array(F.collect_list(entropy)).alias("r"), F.max("n").alias("n"))
        apart = F.when(F.size("r") > 1, F.get("r", F.lit(1))["entropy"] - F.col("r")[0]["entropy"]).otherwise(1.0)
        return ranked.select("key", F.col("r")[0]["lang"].alias("best"), (apart * F.sqrt("n")).alias("gap"))

    def calibrate(self, rows: DataFrame) -> None:
        rows = cut(rows.select("lang", "text", text_key("text").alias("key")))
        found = rows.join(self.margins(rows.select("key", "text").dropDuplicates(["key"])), "key").select("gap", (F.col("best") == F.col("lang")).cast("double").alias("right")).toPandas()
        if len(found):
            self.slope, self.intercept = curve(found["gap"].to_numpy(), found["right"].to_numpy())


def text_key(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def learnable(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows (lang, text) to count, and those that calibrate: up to ``CALIBRATION`` different texts.

    They are the first by hash of one in ``FOLD`` texts; no copy of a chosen text is
    counted under its language.
    """
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("drawn"), F.xxhash64("lang", "text").alias("mark"))
    inside = F.pmod("drawn", F.lit(FOLD)) == 0
    common = rows.where(~inside).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ROWS).select("lang")
    drawn = rows.where(inside).select("lang", "drawn", "mark").distinct().join(common, "lang", "left_semi")
    chosen = cut(drawn.orderBy("drawn", "mark").limit(CALIBRATION).select("mark"), small=True)
    calibrating = rows.join(F.broadcast(chosen), "mark").groupBy("mark").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    return rows.join(F.broadcast(chosen), "mark", "left_anti").select("lang", "text"), calibrating.select("lang", "text")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Models | Joined:
    """Models from every row with text and language that is not held out and does not calibrate.

    What comes to the driver is bounded: tables of ``MOST_LOADED`` rows and
    ``MOST_LANGUAGES`` languages, else none (``Joined``), and two numbers for each
    of the ``CALIBRATION`` texts (see ``learnable``). Without any of those the
    score of a text with letters is one half.
    """
    counting, rows = learnable(docs, text_col, lang_col, id_col)
    counts = cut(counted(counting, "text", "lang"))
    full = cut(tables(counts))
    extent = full.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("languages")).first()
    if extent.n > MOST_LOADED or extent.languages > MOST_LANGUAGES:
        joined = Joined(full)
        joined.calibrate(rows)
        return joined
    table = full.toArrow()
    names = pa.chunked_array([table["lang"].combine_chunks()]).combine_chunks().dictionary_encode()
    lang, names = names.indices.to_numpy(), names.dictionary.to_pylist()
    size, part = table["size"].to_numpy(), table["part"].to_numpy()
    key, value = mixed(table["code"].to_numpy().view(np.uint64)), table["value"].to_numpy()
    models = Models(sorted(names))
    for name in models.languages:
        arrays = {}
        for k in range(1, ORDER + 1):
            both = []
            for p in (0, 1):
                mine = np.flatnonzero((lang == names.index(name)) & (size == k) & (part == p))
                order = np.argsort(key[mine])
                both += [key[mine][order], value[mine][order]]
            arrays[k] = tuple(both)
        models.arrays.append(arrays)
    models._forget()
    models.calibrate(rows)
    return models


def identify(docs: DataFrame, models: Models | Joined, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    Texts that are null or have no letter are ``und`` with score 0, as is every
    text when no language could be learned; of equal cross-entropies the first
    language in name order counts; repeated rows are predicted each; an empty table
    gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    if isinstance(models, Joined):
        rows = rows.withColumn("key", text_key("text"))
        found = models.margins(rows.select("key", "text").dropDuplicates(["key"]))
        score = F.coalesce(F.floor(DIGITS / (1 + F.exp(-(models.slope * F.col("gap") + models.intercept))) + 0.5) / DIGITS, F.lit(0.0))
        known = rows.drop("text").join(found, "key", "left").withColumn("score", score)
        return known.select("doc_id", "held_out", F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"), "score", (F.col("score") < REJECT_BELOW).alias("rejected"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lang, score = models.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(score < REJECT_BELOW)],
                    names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
