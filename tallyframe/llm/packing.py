"""Order-preserving packing of documents into fixed windows.

The tokens of a partition's documents, in their order, form one stream. Window
cuts are chosen by dynamic programming over candidate positions: after a
document (free) and after a sentence (a small penalty). Only a stretch that has
neither for a sixteenth of a window, such as a list without full stops, may be cut
inside, at a grid of places with a larger penalty, so that it costs no more padding
than that. A window of n tokens costs its padding, ``window - n``, so with f(i) the
least cost up to position i

    f(j) = penalty(j) + window - j + min over i in [j - window, j) of (f(i) + i)

and the minimum slides: a monotone queue gives every f(j) in constant time. The
last windows of a partition are powers of two, which need no padding and end anywhere.

Partitions are packed on their own, without a shuffle, in bounded blocks: the
last, unfinished window of a block is carried into the next one.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import _ODD_SPACE

#: What it costs to cut a document after a sentence, and elsewhere, in tokens of padding; how far apart the other places are,
#: and which part of a window a stretch without a boundary must be longer than to have them.
SENTENCE, ELSEWHERE, GRID, STRETCH = 8, 24, 48, 16
#: Tokens of a block; words remembered by a task, and by one that gives them back at its end.
BLOCK, MOST_KEPT, MOST_LENT, LONGEST_KEPT = 1 << 20, 1_200_000, 300_000, 64
MARK = "\x02"


class WordIds(dict):
    """Ids of white-space separated words, packed; unknown words go to the library together.

    The vocabulary's normalizer and pattern never look across white space, so a
    text's ids are those of its words, one after the other; a word with closing
    marks is put together from its letters and its marks.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        self.library = Tokenizer.from_file(vocabulary)
        self.new: dict[str, None] = {}
        self.most = MOST_KEPT
        self.mark = self.ids(MARK)[0]
        ends = [self.ids(c)[-1] for c in ".!?"]
        self.sentence_ends = np.array(sorted(set(ends)), np.uint32)

    def __missing__(self, word: str) -> None:
        self.new[word] = None

    def forget(self) -> None:
        self.clear()

    def ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def parts(self, word: str) -> tuple[str, str]:
        """The word as (letters, closing marks) where their ids are those of the two, else (word, "")."""
        core = word.rstrip(".,!?;:")
        low = core.lower()
        if low.isalpha() and (core.isascii() or "\u03c2" not in low and "\u03c3" not in low and unicodedata.is_normalized("NFC", core)):
            return low, word[len(core) :]
        return word, ""

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if w and MARK not in w]
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self.ids(f" {MARK} ".join(some)), "<u4")
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(some) - 1:
                raise ValueError("the vocabulary joins words across the mark")
            raw, edges = ids.tobytes(), [0, *(4 * cut + 4).tolist(), 4 * len(ids) + 4]
            self.update(zip(some, [raw[a : b - 4] for a, b in zip(edges, edges[1:])]))
        self.update((w, np.array(self.ids(w), "<u4").tobytes()) for w in words if MARK in w or not w)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        if len(self) > self.most:
            self.clear()
        split = [[t] if _ODD_SPACE.search(t) else t.split() for t in texts]
        rows = [list(map(self.__getitem__, words)) for words in split]  # words that are not known yet give None
        new, self.new = self.new, {}
        if new:
            unknown = {w for w in new if w.islower() and w.isascii() and w.isalpha()}
            joined = {w: self.parts(w) for w in new if w not in unknown}
            unknown.update(p for both in joined.values() for p in both if p not in self)
            self.learn(list(unknown))
            self.update([(w, self[a] + self[b]) for w, (a, b) in joined.items() if b or a != w])
            rows = [[self[w] if x is None else x for w, x in zip(words, row)] if None in row else row for words, row in zip(split, rows)]
            for word in [w for some in (new, unknown) for w in some if len(w) > LONGEST_KEPT]:
                self.pop(word, None)
        return list(map(b"".join, rows))


@lru_cache(maxsize=2)
def word_ids(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Increasing positions at which a window may end, and their penalties."""
    penalty = np.full(len(ids) + 1, -1, np.int32)
    penalty[np.flatnonzero(np.isin(ids, sentence_ends)) + 1] = SENTENCE
    penalty[doc_ends] = 0
    step, longest = min(GRID, window), max(window // STRETCH, 1)
    bounds = np.append(0, np.flatnonzero(penalty[1:] >= 0) + 1)
    for k in np.flatnonzero(np.diff(bounds) > longest):
        penalty[bounds[k] + step : bounds[k + 1] : step] = ELSEWHERE
    at = np.flatnonzero(penalty[1:] >= 0) + 1
    return at, penalty[at]


def cheapest_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Ends of the windows, the last of them the last candidate, at least total cost.

    The last window costs nothing: it is carried on or cut into powers of two.
    """
    places, costs = [0, *at.tolist()], [0, *penalty.tolist()]
    best, back = [0] * len(places), [0] * len(places)
    queue: deque[int] = deque([0])  # places of increasing f(i) + i
    for k in range(1, len(places)):
        j = places[k]
        while places[queue[0]] < j - window:
            queue.popleft()
        i = queue[0]
        best[k], back[k] = costs[k] + window - j + best[i] + places[i], i
        value = best[k] + j
        while queue and best[queue[-1]] + places[queue[-1]] >= value:
            queue.pop()
        queue.append(k)
    last = len(places) - 1
    within = range(bisect_left(places, places[last] - window), last)
    cuts, k = [places[last]], min(within, key=lambda i: (best[i], -i))
    while k:
        cuts.append(places[k])
        k = back[k]
    return cuts[::-1]


class Packer:
    """Packs a stream of documents; yields rows of pieces."""

    def __init__(self, sentence_ends: np.ndarray, window: int, first_sequence: int):
        self.sentence_ends, self.window, self.sequence = sentence_ends, window, first_sequence
        self.docs: list[list] = []  # [id, ids of what is not yet emitted, start, total]
        self.size = 0

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append([doc_id, ids, 0, len(ids)])
        self.size += len(ids)
        if self.size >= BLOCK:
            yield from self.pack(False)

    def pack(self, last: bool):
        if not self.docs:
            return
        stream = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        cuts = cheapest_cuts(*candidates(stream, ends, self.sentence_ends, self.window), self.window)
        start = cuts[-2] if len(cuts) > 1 else 0
        cuts = cuts[:-1]
        if last:
            left = len(stream) - start
            while left:  # powers of two, which are not padded
                step = 1 << (left.bit_length() - 1)
                start, left = start + step, left - step
                cuts.append(start)
        yield from self.emit(cuts)

    def emit(self, cuts: list[int]):
        at = k = 0
        for cut in cuts:
            offset = 0
            while at < cut:
                doc_id, ids, start, total = self.docs[k]
                n = min(len(ids), cut - at)
                yield doc_id, start, n, total, self.sequence, offset, ids[:n].tobytes()
                at, offset = at + n, offset + n
                if n == len(ids):
                    k += 1
                else:
                    self.docs[k] = [doc_id, ids[n:], start + n, total]
            self.sequence += 1
        self.docs = self.docs[k:]
        self.size -= at


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id", remember: bool = True) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``window`` ids.

    Rows: doc_id, start and length (which of the document's ids), doc_tokens,
    sequence_id, offset, ids (binary, little-endian unsigned 32-bit). A document's
    ids are its text's and ``end_id``; null text counts as empty, so such a
    document is one id. Documents keep the order in which their partition is read;
    repeated rows are packed each; an empty table gives no rows; other columns are
    ignored. A sequence is shorter than ``window`` where that cost least, or a
    power of two at a partition's end. With ``remember`` a Python worker keeps its
    bounded memory of words for later tasks; without, it gives it back to others.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        words = word_ids(vocabulary)
        words.most = MOST_KEPT if remember else MOST_LENT
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(words.sentence_ends, window, TaskContext.get().partitionId() << 33)
        out: list[tuple] = []

        def table() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, id_type if k is None else k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), words.encode(some.column("text").to_pylist())):
                    for row in packer.add(doc_id, np.frombuffer(ids + end, "<u4")):
                        out.append(row)
                if len(out) > 1000:
                    yield table()
        out.extend(packer.pack(True))
        if out:
            yield table()
        if not remember:
            words.forget()

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
