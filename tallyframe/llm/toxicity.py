"""Toxicity by a weighted finite-state grammar over clauses.

Six transducers are built as tables and composed. The lexicon reads a word's
characters, down a trie, and emits its kinds (insult, threat, target, negation,
reported speech) and a weight. Five transducers read a clause's word kinds: the
insult and threat transducers emit matches, the negation transducer whether a
negation stands a few words before, the reported-speech transducer whether the
clause reports; the target transducer says at the clause's end, by its final output,
whether somebody is addressed anywhere in it, so an insult may stand before its
target. Their product is one table from (state, kinds) to (state, match), with one
final output a state.

A clause's readings are plain, aimed (an insult and somebody it is meant for), threat
(a threatening verb and a target), vague (such a verb alone), negated and reported,
each with a fixed share of the match's weight, ``SHARES``: an aimed insult says more
than a plain one, a reported one less, a negated one least, whatever the labels are
like. A text's score is a calibrated, rising function of its heaviest clause and of
all its clauses' weight, never of isolated words. Clauses are found in one pass over
a text.

The word lists below are the grammar's start. The insult transducer is completed
from labelled training rows: patterns that occur in toxic texts far beyond chance,
counted once for each group of near copies. A word's start is a pattern of texts in
which two different words share it, and is learned only if several words carry it and
no one word does most of it, so what is learned of one word says nothing of others
that begin alike; one word alone then weighs half of what the start says, and words
that a learned start explains are not learned again.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out
from .learning import fit_logistic, fitted, labelled_sample, sigmoid

#: Rows of the labelled sample; score from which a text counts as toxic.
SAMPLE, TOXIC_FROM = 6000, 0.3
#: A pattern is learned if its toxic texts would come together by chance less often than this.
CHANCE = 1e-6
#: A start is learned if so many different words carry it in toxic texts, and no one word in more than this share of them.
CARRIERS, MOST_OF_ONE = 4, 0.5
#: Letters of a start.
STARTS = range(3, 10)
NEGATION_SPAN = 3

# The grammar's own word lists (English, German, French, Spanish).
INSULTS = {
    "idiot", "moron", "stupid", "pathetic", "worthless", "loser", "scum", "trash", "clown", "disgusting",
    "dumb", "imbecile", "filth", "vermin", "dummkopf", "trottel", "abschaum", "imbécile", "crétin", "ordure",
    "idiota", "imbécil", "basura", "asqueroso",
}
THREATS = {"kill", "hurt", "destroy", "beat", "töten", "vernichten", "tuer", "détruire", "matar", "destruir"}
TARGETS = {"you", "your", "they", "them", "he", "him", "she", "her", "du", "dich", "ihr", "sie", "tu", "toi", "vous", "ils", "tú", "usted", "ellos"}
NEGATIONS = {"not", "no", "never", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "tampoco"}
REPORTS = {"said", "says", "called", "wrote", "quoted", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"}

#: What a listed word weighs before anything is learned, in units of log odds.
LISTED = 4.0
#: Readings of a match, and what each makes of its weight.
SHARES = {"plain": 1.0, "aimed": 1.3, "threat": 1.5, "vague": 0.05, "negated": 0.1, "reported": 0.15}
_CLAUSE = re.compile(r"[.!?;:\n|]+")
_LETTERS = re.compile(r"[^\W\d_]+")


#: Kinds of a word, as bits: the alphabet of the clause transducers is their sums.
INSULT, THREAT, TARGET, NEGATION, REPORT = 1, 2, 4, 8, 16
KINDS = 32
#: Words whose kinds and weights a task remembers.
MOST_KEPT = 200_000


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer over word kinds: by state and kinds the next state, and what is emitted, by state what is emitted at the end; it starts in state 0."""

    next: list[list[int]]
    out: list[list[tuple]]
    final: list[tuple]

    @classmethod
    def of(cls, states: int, move, emit=None, final=None) -> Transducer:
        each = [[(s, k) for k in range(KINDS)] for s in range(states)]
        out = [[(emit(s, k),) if emit else () for s, k in row] for row in each]
        return cls([[move(s, k) for s, k in row] for row in each], out, [(final(s),) if final else () for s in range(states)])

    def compose(self, other: Transducer) -> Transducer:
        """Both side by side on the same word kinds, their outputs joined: the reachable part of the product."""
        ids, todo, after, out, final = {(0, 0): 0}, [(0, 0)], [], [], []
        for a, b in todo:  # grows as states are met
            row = []
            for k in range(KINDS):
                pair = self.next[a][k], other.next[b][k]
                if pair not in ids:
                    ids[pair] = len(ids)
                    todo.append(pair)
                row.append(ids[pair])
            after.append(row)
            out.append([x + y for x, y in zip(self.out[a], other.out[b])])
            final.append(self.final[a] + other.final[b])
        return Transducer(after, out, final)


def _met(kind: int):
    return lambda s, k: int(bool(s or k & kind))


insult_matches = Transducer.of(1, lambda s, k: 0, lambda s, k: int(bool(k & INSULT)))
threat_matches = Transducer.of(1, lambda s, k: 0, lambda s, k: int(bool(k & THREAT)))
addressed = Transducer.of(2, _met(TARGET), final=lambda s: s)
reported = Transducer.of(2, _met(REPORT), _met(REPORT))
negated = Transducer.of(NEGATION_SPAN + 1, lambda s, k: NEGATION_SPAN if k & NEGATION else max(0, s - 1), lambda s, k: int(s > 0))


def _matched(insult: int, threat: int, denied: int, told: int) -> tuple[str, str] | None:
    """The readings of a match, if nobody is addressed and if somebody is; none for no match."""
    if not (insult or threat):
        return None
    if denied or told:
        return ("negated", "negated") if denied else ("reported", "reported")
    return ("plain", "aimed") if insult else ("vague", "threat")


_product = insult_matches.compose(threat_matches).compose(addressed).compose(negated).compose(reported)
#: The composed transducer: by state and word kinds the next state and the match, by state whether somebody was addressed.
NEXT, MATCH, ADDRESSED = _product.next, [[_matched(*o) for o in row] for row in _product.out], [f[0] for f in _product.final]


class Lexicon:
    """A trie over characters that emits a word's kinds and weight at its end, and the weight of word starts on the way."""

    def __init__(self, words: dict[str, float], starts: dict[str, float], threats: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.kinds, self.weight, self.threat, self.start = [0], [0.0], [0.0], [0.0]
        for kind, listed in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            for word in listed:
                self.kinds[self._place(word)] |= kind
        for side, given in ((self.weight, words), (self.start, starts), (self.threat, threats)):
            for word, w in given.items():
                side[self._place(word)] = w
        self._known: dict[str, tuple[int, float]] = {}

    def _place(self, word: str) -> int:
        at = 0
        for c in word:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                for side in (self.kinds, self.weight, self.threat, self.start):
                    side.append(0)
            at = self.next[at][c]
        return at

    def read(self, word: str) -> tuple[int, float]:
        """Kinds and weight; the heaviest matching pattern counts, and a threat only where no insult is."""
        if (found := self._known.get(word)) is None:
            at, weight, after = 0, 0.0, self.next
            for c in word:
                at = after[at].get(c, -1)
                if at < 0:
                    break
                weight = max(weight, self.start[at])
            kinds, threat = 0, 0.0
            if at > 0:
                kinds, weight, threat = self.kinds[at], max(weight, self.weight[at]), self.threat[at]
            if kinds & NEGATION:
                found = kinds, 0.0
            elif weight:
                found = kinds | INSULT, weight
            else:
                found = (kinds | THREAT, threat) if threat else (kinds, 0.0)
            if len(self._known) >= MOST_KEPT:
                self._known.clear()
            self._known[word] = found
        return found


@dataclass
class Grammar:
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(sorted(INSULTS), LISTED))
    starts: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(sorted(THREATS), LISTED))
    slopes: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.5]))
    intercept: float = -2.5

    def __post_init__(self) -> None:
        self._matcher = self._lexicon = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_matcher": None, "_lexicon": None}

    @property
    def matcher(self):
        """All patterns in one automaton, which finds the clauses worth reading."""
        if self._matcher is None:
            self._lexicon = Lexicon(self.words, self.starts, self.threats)
            self._matcher = ahocorasick.Automaton()
            for pattern in {*self.words, *self.starts, *self.threats}:
                self._matcher.add_word(pattern, len(pattern))
            self._matcher.make_automaton()
        return self._matcher

    def read(self, clause: str) -> list[tuple[str, float]]:
        """The composed transducer's run over one clause: readings and weights of its matches."""
        found, state, read = [], 0, self._lexicon.read
        for word in _LETTERS.findall(clause):
            kinds, weight = read(word)
            if match := MATCH[state][kinds]:
                found.append((match, weight))
            state = NEXT[state][kinds]
        return [(match[ADDRESSED[state]], weight) for match, weight in found]

    def clauses(self, text: str) -> list[list[tuple[str, float]]]:
        """Readings of the clauses that match anything."""
        low = text.lower()
        marks = _CLAUSE.finditer(low)
        mark, head, found, done = next(marks, None), 0, [], -1
        for end, size in self.matcher.iter(low):
            begin = end - size + 1
            if begin <= done or begin and low[begin - 1].isalpha():
                continue
            while mark is not None and mark.start() < begin:
                head, mark = mark.end(), next(marks, None)
            done = mark.start() if mark else len(low)
            if matches := self.read(low[head:done]):
                found.append(matches)
        return found

    def features(self, text: str) -> np.ndarray:
        """The logs of the heaviest clause's weight and of all clauses'."""
        heavy, total = 0.0, 0.0
        for matches in self.clauses(text):
            weight = sum(SHARES[r] * w for r, w in matches)
            heavy, total = max(heavy, weight), total + weight
        return np.log1p([heavy, total])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) if t else np.zeros(2) for t in texts]).reshape(len(texts), -1)
        return sigmoid(x @ self.slopes + self.intercept)


def patterns_of(text: str) -> set[str]:
    """Whole words, and, marked by a closing star, the starts that two different words of the text share."""
    words = set(_LETTERS.findall(text.lower()))
    shared = Counter(w[:n] + "*" for w in words for n in STARTS if len(w) >= n)
    return words.union(p for p, n in shared.items() if n > 1)


def near_copies(texts: list[str]) -> list[int]:
    """A number for each text that near copies mostly share: its smallest word-pair hash."""
    found = []
    for text in texts:
        words = text.lower().split()
        found.append(min((zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:])), default=zlib.crc32(text.encode())))
    return found


def learn(rows: list[tuple[int, str]]) -> Grammar:
    """The insult transducer from (label, text) rows."""
    toxic: dict[int, set[str]] = {}
    clean: dict[int, list[str]] = {}
    for group, (y, text) in zip(near_copies([t for _, t in rows]), rows):
        if y:
            toxic.setdefault(group, set()).update(patterns_of(text))
        else:
            clean.setdefault(group, []).append(text)
    every = Counter(p for found in toxic.values() for p in found)
    times = Counter({p: n for p, n in every.items() if n >= 4})
    plain: Counter[str] = Counter()
    for texts in clean.values():
        plain.update({p for t in texts for p in patterns_of(t) if p in times})
    grammar = Grammar()
    if not toxic or not clean:
        return grammar
    carriers: dict[str, list[int]] = {}
    for word, n in every.items():
        if not word.endswith("*"):
            for k in STARTS[: max(0, len(word) - STARTS[0] + 1)]:
                carriers.setdefault(word[:k] + "*", []).append(n)
    share = len(toxic) / (len(toxic) + len(clean))

    def odds_of(pattern: str) -> float:
        """Log odds of a pattern, 0 if it may well be chance."""
        t, c = times[pattern], plain[pattern]
        rate = t / (t + c)
        if rate <= share:
            return 0.0
        # chance that at least t of t + c texts are toxic, bounded from above (Chernoff)
        bound = t * math.log(rate / share) + (c * math.log((1 - rate) / (1 - share)) if c else 0)
        odds = math.log((t + 0.5) / (len(toxic) + 1)) - math.log((c + 0.5) / (len(clean) + 1))
        return round(odds, 6) if bound > -math.log(CHANCE) and odds > 2.5 else 0.0

    found = {p: w for p in times if (w := odds_of(p))}
    starts = [p for p in found if p.endswith("*") and len(carriers[p]) >= CARRIERS and max(carriers[p]) <= MOST_OF_ONE * times[p]]
    for pattern in sorted(starts, key=lambda p: (-found[p], -len(p), p)):  # a start of a learned one says nothing of its own
        name = pattern.rstrip("*")
        if not any(s.startswith(name) for s in grammar.starts):
            grammar.starts[name] = found[pattern] / 2
    for word, w in found.items():
        if not word.endswith("*") and not any(word[:n] in grammar.starts for n in STARTS):
            grammar.words[word] = max(grammar.words.get(word, 0.0), w)
    return grammar


def fit(rows: list[tuple[int, str]]) -> Grammar:
    """Learn patterns on all rows; calibrate with patterns that had not seen the row.

    Each half is read by the grammar of the other half. Without rows of both
    classes the fixed lists and default slopes remain.
    """
    half = [zlib.crc32(str(g).encode()) % 2 for g in near_copies([t for _, t in rows])]
    parts = [[r for r, h in zip(rows, half) if h == k] for k in (0, 1)]
    whole = learn(rows)
    y, x = [], []
    for mine, other in (parts, parts[::-1]):
        grammar = learn(other)
        x += [grammar.features(t) for _, t in mine]
        y += [label for label, _ in mine]
    y = np.array(y, float)
    if len(y) >= 8 and 0 < y.sum() < len(y):
        whole.slopes, whole.intercept = fit_logistic(np.array(x), y, l2=0.5)
        whole.slopes = np.maximum(whole.slopes, 0)  # more weight never lowers a score
    return whole


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> Grammar:
    """The grammar from at most ``sample`` labelled rows, held-out rows excluded; learned in one task."""

    def learned(table: pa.Table) -> Grammar:
        table = table.sort_by("doc_id")
        return fit(list(zip(table["y"].to_pylist(), table["text"].to_pylist())))

    return fitted(labelled_sample(docs, labels, "toxic", sample, text_col, id_col, only_training=True), learned)


def score(docs: DataFrame, grammar: Grammar, threshold: float = TOXIC_FROM, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts have no matched clause and get the grammar's base score;
    a null id counts as the empty string for ``held_out``; repeated rows are scored
    each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            found = grammar.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, grammar: Grammar, threshold: float = TOXIC_FROM, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they were."""
    text = fresh(docs, "text_scored")

    def run(batches):
        for batch in batches:
            keep = grammar.scores(batch.column(text).to_pylist()) < threshold
            yield batch.filter(pa.array(keep)).select([c for c in batch.schema.names if c != text])

    return docs.withColumn(text, F.col(text_col)).mapInArrow(run, docs.schema)
