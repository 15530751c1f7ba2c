"""Token counts by a compiled finite-state transducer.

Byte-level BPE is compiled, on demand, into one deterministic transducer over
characters. A state is (kind of pretoken, pending white space, piece state): the
kinds follow the pretokenizer's pattern, and the piece state is what later bytes
can still change -- the longest suffix of the piece that starts a longer token,
with the last token and the relative token count at each position where such a
token can begin. Last tokens whose right edges can take part in the same merges
are one state. A
transition carries the change of the token count, which is negative where tokens
merge. Merging is local: a token sequence is the encoding of its bytes exactly if
each neighbouring pair is the encoding of its own bytes, so one last token at
each position decides everything to the right.

Texts are cut into chunks of fixed width. A chunk's state map is constant from
its first reset on (ASCII white space after a character that is no white space always
starts a pretoken, whatever came before), so resets give spans with known entry
states, which advance in lock-step, one table lookup for all of them at a time.
Where a stretch holds no reset for long, its chunks get state maps: from the entry
states that a short run-up makes likely to (exit state, count). Neighbouring maps
are composed pairwise up a tree, all pairs of a level at once; an exit that is not
in the next map's domain extends that map by running its chunk from it, so the
composition is exact whatever the guesses were.

Transitions on the first characters met stand in a table with a column each, those on
all others in a table of fixed size addressed by a hash of (state, character), where a
newer transition takes the place of an older one; both are looked up for all spans at
once, and only transitions that are not there are worked out one by one.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

CHUNK = 512
#: Length of a span from which its chunks get state maps, and of the run-up that guesses their entry states.
LONG, RUN_UP = 4 * CHUNK, 64
#: Code points handled together, and states kept before the compiled part is dropped and built anew.
BATCH_CHARS, MAX_STATES, MAX_SYMBOLS = 3_000_000, 120_000, 128
#: Bits of an address in the table of transitions on characters without a column.
RARE_BITS = 20

WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0" + chr(0x1680) + "".join(map(chr, range(0x2000, 0x200B))) + chr(0x2028) + chr(0x2029) + chr(0x202F) + chr(0x205F) + chr(0x3000))

_OTHER_WHITE = np.array(sorted(ord(c) for c in WHITE if ord(c) > 32), np.uint32)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


_split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str


@lru_cache(maxsize=None)
def char_class(c: str) -> str:
    """White space, letter, number or other, as the library's own pattern takes it: by what it joins."""
    if c in WHITE:
        return "W"
    if len(_split("a" + c)) == 1:
        return "L"
    return "N" if len(_split("1" + c)) == 1 else "O"


#: At a position where no token can begin any more.
_NEVER = (b"", 0)


class Pieces:
    """States of a pretoken's prefix, built as they are met."""

    def __init__(self, merges: dict[tuple[bytes, bytes], int], tokens: set[bytes]):
        self.merges = merges
        self.prefixes = {t[:k] for t in tokens for k in range(len(t))}
        self.tokens = tokens
        self.parts = {a + b: (b, k) for (a, b), k in merges.items()}
        self.lefts = {a for a, _ in merges}
        self._like: dict[bytes, bytes] = {}
        self._edges: dict[tuple, bytes] = {}
        self._pair: dict[tuple[bytes, bytes], bool] = {}
        self._alone: dict[bytes, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}
        self.root = self.intern((b"", ((None, 0),)))

    def intern(self, state: tuple) -> int:
        k = self.ids.get(state)
        if k is None:
            k = self.ids[state] = len(self.states)
            self.states.append(state)
        return k

    def merge(self, piece: bytes) -> list[bytes]:
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            ranked = [self.merges.get(pair, 1 << 30) for pair in zip(parts, parts[1:])]
            best = min(ranked)
            if best == 1 << 30:
                break
            k = ranked.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def stands(self, token: bytes) -> bool:
        """The token is its own encoding."""
        if (found := self._alone.get(token)) is None:
            found = self._alone[token] = self.merge(token) == [token]
        return found

    def joins(self, left: bytes, right: bytes) -> bool:
        """The two tokens side by side are the encoding of their bytes."""
        if (found := self._pair.get((left, right))) is None:
            if len(self._pair) > 1_000_000:
                self._pair.clear()
            found = self._pair[left, right] = self.merge(left + right) == [left, right]
        return found

    def like(self, token: bytes) -> bytes:
        """One token for all those whose right edge can merge alike: the same parts, until the same ranks."""
        if (found := self._like.get(token)) is None:
            edge, part, until = [], token, -1
            while True:
                if part in self.lefts:
                    edge.append((part, until))
                if part not in self.parts:
                    break
                part, until = self.parts[part]
            found = self._like[token] = self._edges.setdefault(tuple(edge), token)
        return found

    def step(self, at: int, byte: int) -> tuple[int, int]:
        """The next state and the change of the token count."""
        if (found := self.moves.get((at, byte))) is not None:
            return found
        suffix, context = self.states[at]
        suffix += bytes((byte,))
        for k in range(len(suffix)):
            token, before = suffix[k:], context[k][0]
            if token in self.tokens and self.stands(token) and (before is None or self.joins(before, token)):
                delta = context[k][1] + 1
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        prefixes, drop = self.prefixes, 0
        while suffix[drop:] not in prefixes:
            drop += 1
        kept = suffix[drop:]
        context = [(c[0], c[1] - delta) if kept[k:] in prefixes else _NEVER for k, c in enumerate(context[drop:])]
        if kept:
            context.append((self.like(token), 0))
        else:
            context = [(self.like(token), 0)]
        found = self.moves[at, byte] = (self.intern((kept, tuple(context))), delta)
        return found

    def walk(self, at: int, text: str) -> tuple[int, int]:
        total = 0
        for byte in text.encode():
            at, delta = self.step(at, byte)
            total += delta
        return at, total


#: Contractions that are pretokens of their own, after the apostrophe.
_SHORT, _LONG = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}


class Transducer:
    """The composed character transducer with its tables."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = sorted(special, key=len, reverse=True)
        self.pieces = Pieces(
            {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)},
            {raw(t) for t in spec["model"]["vocab"] if t not in special},
        )
        self.column = np.full(0x110000, -1, np.int16)
        self.symbols: list[str] = []
        self.clear()

    def clear(self) -> None:
        self.pieces.clear()
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.last = np.zeros(1 << 10, np.int8)
        self.next = np.full((1 << 10, MAX_SYMBOLS), -1, np.int32)
        self.delta = np.zeros((1 << 10, MAX_SYMBOLS), np.int8)
        self.rare_key = np.full(1 << RARE_BITS, -1, np.int64)
        self.rare_next = np.zeros(1 << RARE_BITS, np.int32)
        self.rare_delta = np.zeros(1 << RARE_BITS, np.int8)
        self.start = self.intern(("S", "", self.pieces.root))

    def intern(self, state: tuple) -> int:
        k = self.ids.get(state)
        if k is None:
            k = self.ids[state] = len(self.states)
            self.states.append(state)
            if k == len(self.next):
                more = k // 4
                self.next = np.concatenate([self.next, np.full((more, MAX_SYMBOLS), -1, np.int32)])
                self.delta = np.concatenate([self.delta, np.zeros((more, MAX_SYMBOLS), np.int8)])
                self.last = np.concatenate([self.last, np.zeros(more, np.int8)])
            if state[0] == "W":  # white space still pending at the end of a text joins its run
                self.last[k] = self.pieces.walk(state[2], state[1])[1]
        return k

    def begin(self, c: str) -> tuple[tuple, int]:
        kind = char_class(c)
        if kind == "W":
            return ("W", c, self.pieces.root), 0
        q, n = self.pieces.walk(self.pieces.root, c)
        return ("A" if c == "'" else kind, "", q), n

    def move(self, at: int, c: str) -> tuple[int, int]:
        kind, pending, q = self.states[at]
        pieces, now = self.pieces, char_class(c)
        if kind == "W":
            if now == "W":
                q, n = pieces.walk(q, pending)
                return self.intern(("W", c, q)), n
            if pending == " ":
                q, n = pieces.walk(pieces.root, pending + c)
                return self.intern((now, "", q)), n
            (state, n), alone = self.begin(c), pieces.walk(pieces.root, pending)[1]
            return self.intern(state), n + alone
        if kind == now and kind in "LNO" or kind == "A" and now == "O":
            q, n = pieces.walk(q, c)
            return self.intern((now, "", q)), n
        if kind == "A" and c in _SHORT:
            return self.intern(("C", "", pieces.root)), pieces.walk(q, c)[1]
        if kind == "A" and c in _LONG:  # an apostrophe and a letter run, unless the contraction completes
            q, n = pieces.walk(pieces.root, c)
            return self.intern(("A" + c, "", q)), n
        if len(kind) == 2 and c == _LONG[kind[1]]:
            parted = pieces.walk(pieces.root, "'")[1] + pieces.walk(pieces.root, kind[1])[1]
            return self.intern(("C", "", pieces.root)), pieces.walk(pieces.root, "'" + kind[1] + c)[1] - parted
        if len(kind) == 2 and now == "L":
            q, n = pieces.walk(q, c)
            return self.intern(("L", "", q)), n
        state, n = self.begin(c)
        return self.intern(state), n

    def _columns(self, points: np.ndarray) -> np.ndarray:
        found = self.column[points]
        if (found < 0).any() and len(self.symbols) < MAX_SYMBOLS:
            new, times = np.unique(points[found < 0], return_counts=True)
            for p in new[np.argsort(-times)][: MAX_SYMBOLS - len(self.symbols)]:
                self.column[p] = len(self.symbols)
                self.symbols.append(chr(p))
            found = self.column[points]
        return found

    def rare(self, states: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of the count on characters without a column."""
        key = (states << 21) | points
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - RARE_BITS)).astype(np.int64)
        to, n = self.rare_next[slot], self.rare_delta[slot]
        missing = np.flatnonzero(self.rare_key[slot] != key)
        if len(missing):
            distinct, back = np.unique(key[missing], return_inverse=True)
            found = np.array([self.move(k >> 21, chr(k & 0x1FFFFF)) for k in distinct.tolist()])[back]
            to[missing], n[missing] = found[:, 0], found[:, 1]
            some = slot[missing]
            self.rare_key[some], self.rare_next[some], self.rare_delta[some] = key[missing], to[missing], n[missing]
        return to, n

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; texts hold no special strings."""
        if len(self.states) > MAX_STATES:
            self.clear()
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        total = np.zeros(len(texts), np.int64)
        if not len(points):
            return total
        symbol = self._columns(points)
        starts, owner = spans(points, ends)
        lengths = np.diff(np.append(starts, len(points)))
        counts = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(lengths <= LONG)
        if len(short):
            state, n = self.advance(points, symbol, starts[short], lengths[short], np.full(len(short), self.start))
            counts[short] = n + self.last[state]
        for k in np.flatnonzero(lengths > LONG):
            counts[k] = self.scanned(points, symbol, int(starts[k]), int(lengths[k]))
        np.add.at(total, owner, counts)
        return total

    def advance(self, points: np.ndarray, symbol: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of spans from their entry states, all in lock-step."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, state = starts[order], lengths[order], entries[order].astype(np.int64)
        counts = np.zeros(len(starts), np.int64)
        live_at = len(starts) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        for k, live in enumerate(live_at):
            now, at = state[:live], starts[:live] + k
            column = symbol.take(at)
            some = slice(None)
            if column.min() < 0:  # characters without a column of their own
                lanes = np.flatnonzero(column < 0)
                now[lanes], n = self.rare(now[lanes], points[at[lanes]].astype(np.int64))
                counts[lanes] += n
                some = np.flatnonzero(column >= 0)
                column = column[some]
                if not len(some):
                    continue
            cell = now[some] * MAX_SYMBOLS
            cell += column
            after = self.next.take(cell)
            if after.min() < 0:
                for missing in np.unique(cell[after < 0]):
                    s, c = divmod(int(missing), MAX_SYMBOLS)
                    to, n = self.move(s, self.symbols[c])
                    self.next[s, c], self.delta[s, c] = to, n
                after = self.next.take(cell)
            now[some] = after
            counts[:live][some] += self.delta.take(cell)
        back = np.argsort(order)
        return state[back], counts[back]

    def scanned(self, points: np.ndarray, symbol: np.ndarray, start: int, length: int) -> int:
        """Tokens of one long span: its chunks' state maps, composed pairwise up a tree."""
        edges = np.arange(start, start + length, CHUNK)
        sizes = np.minimum(CHUNK, start + length - edges)
        guesses, _ = self.advance(points, symbol, edges[1:] - RUN_UP, np.full(len(edges) - 1, RUN_UP), np.full(len(edges) - 1, self.start))
        entries = [self.start, *guesses.tolist()]
        #: by level and node: entry state to (exit state, count); a node covers two of the level below
        levels: list[list[dict[int, tuple[int, int]]]] = [[{} for _ in edges]]
        while len(levels[-1]) > 1:
            levels.append([{} for _ in range((len(levels[-1]) + 1) // 2)])
        alike: dict[tuple[bytes, int], tuple[int, int]] = {}  # chunks of the same characters

        def extend(level: int, wanted: list[tuple[int, int]]) -> None:
            maps = levels[level]
            missing = list(dict.fromkeys((k, e) for k, e in wanted if e not in maps[k]))
            if not missing:
                return
            if not level:
                text = {k: points[edges[k] : edges[k] + sizes[k]].tobytes() for k, _ in missing}
                new = list({(text[k], e): k for k, e in missing if (text[k], e) not in alike}.items())
                if new:
                    at = np.array([k for _, k in new])
                    found = self.advance(points, symbol, edges[at], sizes[at], np.array([e for (_, e), _ in new]))
                    alike.update(zip((key for key, _ in new), zip(*(f.tolist() for f in found))))
                for k, e in missing:
                    maps[k][e] = alike[text[k], e]
                return
            below = levels[level - 1]
            extend(level - 1, [(2 * k, e) for k, e in missing])
            extend(level - 1, [(2 * k + 1, below[2 * k][e][0]) for k, e in missing if 2 * k + 1 < len(below)])
            for k, e in missing:
                out, n = below[2 * k][e]
                if 2 * k + 1 < len(below):
                    out, more = below[2 * k + 1][out]
                    n += more
                maps[k][e] = out, n

        for level, nodes in enumerate(levels):
            extend(level, [(k, entries[k << level]) for k in range(len(nodes))])
        out, n = levels[-1][0][self.start]
        return n + int(self.last[out])


def spans(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and owners of the spans with known entry state: at each text's start and
    at the first reset at or after each chunk's start."""
    begins = np.append(0, ends[:-1])
    full = ends > begins
    white = (points == 32) | ((points >= 9) & (points <= 13))
    resets = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    # after other white space it may stand within a run that is one pretoken
    resets = resets[~np.isin(points[resets - 1], _OTHER_WHITE)]
    # the state map of a chunk is constant from its first reset
    chunk = resets // CHUNK
    first = resets[np.flatnonzero(np.diff(chunk, prepend=-1))]
    marks = np.zeros(len(points), bool)
    marks[first] = True
    marks[begins[full]] = True
    starts = np.flatnonzero(marks)
    scan = np.zeros(len(points), np.int32)
    scan[begins[full]] = np.flatnonzero(full)
    owner = np.maximum.accumulate(scan)[starts]
    return starts, owner


@lru_cache(maxsize=2)
def transducer(vocabulary: str) -> Transducer:
    return Transducer(vocabulary)


def count_tokens(texts: list[str | None], vocabulary: str) -> np.ndarray:
    """Token counts of whole texts; a special string counts as one token and parts the text."""
    machine = transducer(vocabulary)
    parts: list[str] = []
    owner: list[int] = []
    total = np.zeros(len(texts), np.int64)

    def flush() -> None:
        np.add.at(total, owner, machine.count(parts))
        parts.clear()
        owner.clear()

    size = 0
    for k, text in enumerate(texts):
        pieces = [text or ""]
        for special in machine.special:
            if special in pieces[0] or len(pieces) > 1:
                cut = [p.split(special) for p in pieces]
                total[k] += sum(len(c) - 1 for c in cut)
                pieces = [x for c in cut for x in c]
        parts += pieces
        owner += [k] * len(pieces)
        size += len(text or "")
        if size >= BATCH_CHARS:
            flush()
            size = 0
    flush()
    return total


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated
    rows are counted each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")

    def count(batches):
        for batch in batches:
            tokens = count_tokens(batch.column("text").to_pylist(), vocabulary)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
