"""Byte-level BPE encoding and decoding as a tree reduction.

A piece (one match of the pretokenizing pattern) is halved until a leaf is short,
the leaves are merged directly, and neighbours are joined on the way up. Joining
re-encodes a window of tokens around the seam and grows it until the tokens
outside provably stay: merging is local, so a token sequence is the encoding of
its bytes exactly if each neighbouring pair is the encoding of its own bytes, and
it is enough to see that for the pairs at the window's two edges. Decoding
concatenates halves up the same tree.

Which characters are letters, numbers or white space is the library's own table,
asked once a worker, since the tables of two regular-expression engines differ.

White space after another character always starts a piece, so a text is the
concatenation of independent units (white space and the word behind it), which
are encoded once per task and remembered within a bound.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _ODD_SPACE

LEAF = 16
#: Units longer than this are not remembered; the memory is emptied at its bound.
LONGEST_KEPT, MOST_KEPT = 64, 400_000
_UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_END = 1 << 62


#: A character of each class that both engines know, and that no pattern names.
_STAND_INS = {r"\p{L}": "\u00e9", r"\p{N}": "9", r"\s": "\u2003"}


@lru_cache(maxsize=1)
def disputed() -> dict[int, str]:
    """Code points that the library puts into another class than the ``regex`` package, and a stand-in of the library's class."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes((b,)): b for b in range(256)}
    theirs: dict[str, str] = {}
    wrong: set[str] = set()
    for kind, stand_in in _STAND_INS.items():  # text between matches is left out, so the ids are those of the class alone
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={})
        members = set(bytes(probe.encode_ordinary(every)).decode())
        wrong |= members.symmetric_difference(regex.findall(kind, every))
        theirs |= dict.fromkeys(members, stand_in)
    return {ord(c): theirs.get(c, "!") for c in wrong}


class ByteBpe(dict):
    """Encoder for one rank file; as a dict it maps units to their ids, packed little-endian."""

    def __init__(self, rank_file: str, pattern: str):
        super().__init__()
        self.ranks: dict[bytes, int] = {}
        with open(rank_file, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.table = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.table[rank] = token
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self.matches = regex.compile(pattern)
        self.disputed = disputed()
        self._pair: dict[tuple[bytes, bytes], bool] = {}
        self._piece: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """Repeatedly merge the leftmost neighbours of lowest rank."""
        if len(piece) > 4 * LEAF:
            return self._merge_long(piece)
        get = self.ranks.get
        parts = [piece[k : k + 1] for k in range(len(piece))]
        ranked = [get(piece[k : k + 2], _END) for k in range(len(piece) - 1)]
        while ranked:
            best = min(ranked)
            if best == _END:
                break
            k = ranked.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranked[k]
            if k < len(ranked):
                ranked[k] = get(parts[k] + parts[k + 1], _END)
            if k:
                ranked[k - 1] = get(parts[k - 1] + parts[k], _END)
        return parts

    def _merge_long(self, piece: bytes) -> list[bytes]:
        """The same with a heap over the seams, for windows that grew large."""
        n = len(piece)
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        heap = [(r, k, 1, 1) for k in range(n - 1) if (r := self.ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (r := self.ranks.get(piece[a : b + size[b]])) is not None:
                heapq.heappush(heap, (r, a, size[a], size[b]))

        while heap:
            _, a, la, lb = heapq.heappop(heap)
            b = after[a]
            if size[a] != la or b >= n or size[b] != lb:
                continue
            size[a], size[b] = la + lb, 0
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        parts, k = [], 0
        while k < n:
            parts.append(piece[k : k + size[k]])
            k = after[k]
        return parts

    def joins(self, left: bytes, right: bytes) -> bool:
        if (found := self._pair.get((left, right))) is None:
            if len(self._pair) > MOST_KEPT:
                self._pair.clear()
            found = self._pair[left, right] = self.merge(left + right) == [left, right]
        return found

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        if self.joins(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            window = self.merge(b"".join(left[len(left) - a :] + right[:b]))
            left_stays = a == len(left) or self.joins(left[-a - 1], window[0])
            right_stays = b == len(right) or self.joins(window[-1], right[b])
            if left_stays and right_stays:
                return left[: len(left) - a] + window + right[b:]
            if not left_stays:
                a = min(2 * a, len(left))
            if not right_stays:
                b = min(2 * b, len(right))

    def tree(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def encode_piece(self, piece: str) -> bytes:
        if (ids := self._piece.get(piece)) is None:
            raw = piece.encode()
            ids = self.packed[raw] if raw in self.packed else b"".join([self.packed[t] for t in self.tree(raw)])
            if len(piece) <= LONGEST_KEPT:
                if len(self._piece) >= MOST_KEPT:
                    self._piece.clear()
                self._piece[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches as the library finds them."""
        if text.isascii() or self.disputed.keys().isdisjoint(map(ord, set(text))):
            return self.matches.findall(text)
        return [text[m.start() : m.end()] for m in self.matches.finditer(text.translate(self.disputed))]

    def encode_unit(self, unit: str) -> bytes:
        return b"".join(map(self.encode_piece, self.pieces(unit)))

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode_unit(unit)
        if len(unit) <= LONGEST_KEPT:
            if len(self) >= MOST_KEPT:
                self.clear()
            self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if _ODD_SPACE.search(text):
            return self.encode_unit(text)
        return b"".join(map(self.__getitem__, _UNIT.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return self._concat(np.frombuffer(ids, "<u4").tolist())

    def _concat(self, ids: list[int]) -> bytes:
        if len(ids) <= 1 << 14:
            return b"".join(map(self.table.__getitem__, ids))
        half = len(ids) // 2
        return self._concat(ids[:half]) + self._concat(ids[half:])


@lru_cache(maxsize=2)
def coder(rank_file: str, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


def _rows(batch: pa.RecordBatch, size: int = 256):
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", decoded: bool = False) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit).

    With ``decoded`` also the binary that the ids decode to. Null text counts as
    empty and gives no ids; null ids of documents stay null; repeated rows are
    encoded each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]

    def run(batches):
        bpe = coder(rank_file, pattern)
        for whole in batches:
            for batch in _rows(whole):
                ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
                columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(tokens: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """The way back: doc_id and the binary ``decoded``; null ids decode to nothing."""
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))

    def run(batches):
        bpe = coder(rank_file, pattern)
        for whole in batches:
            for batch in _rows(whole):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.decode(x) for x in batch.column("ids").to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, decoded binary")
