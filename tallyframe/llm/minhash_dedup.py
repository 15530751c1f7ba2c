"""Near-duplicate groups by banded MinHash, odd sketches and exact confirmation.

1. One pass over the texts gives each document its shingle count, a digest of its
   shingle set, band keys of its MinHash samples and an odd sketch: the parity
   bitmap of the samples. Documents with equal sets are one class.
2. Classes meet in band buckets. A class's popularity is the total size of its
   buckets, and the most popular member of a bucket is its hub: of the variants of
   one text the hub is the one nearest to all others. Each member is compared with
   the hubs of its buckets only, so a group of copies costs a few pairs a member,
   and the links found join nearly all of it.
3. Buckets that still hold several components are compared whole, but only across
   components and only by finer sketches: a bucket's largest component against the
   rest of it, and the rest among itself, in blocks spread over tasks. A pair is
   given by the first band it shares, if it passes. No bucket is capped or skipped.
4. In both steps a pair must be near enough in size and, by the XOR population
   count of its sketches, in estimated similarity (with a margin of six standard
   deviations); the pairs left are confirmed on the full shingle sets.

With 40 bands of 5 samples a pair at similarity 0.8 shares no bucket with a
probability of 1e-7. Step 3 compares as many pairs as a bucket's members outside
its largest component times its size; rows moved grow with that over ``BLOCK``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_width, words_of, written
from .components import components

BANDS, ROWS, SKETCH_BITS = 40, 5, 1024
#: Samples a band and bits of the fine sketches, which candidates for the second step get.
FINE_ROWS, FINE_BITS = 50, 4096
#: Members of a block of a large bucket; members of small buckets that one task compares; pairs compared at a time.
BLOCK, BUNDLE, PAIRS = 4096, 20_000, 20_000
MOST_KEPT = 400_000
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_U64 = np.uint64
_random = np.random.Generator(np.random.PCG64(20240607))
_PLACE = _random.integers(1, 1 << 63, 16, dtype=np.uint64) * _U64(2) + _U64(1)
_SEEDS = _random.integers(0, 1 << 32, BANDS, dtype=np.uint32)
_FACTORS = _random.integers(0, 1 << 31, FINE_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _random.integers(0, 1 << 32, FINE_ROWS, dtype=np.uint32)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MOST_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode())
        return h


_words = WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U64(29))) * _U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; the whole sequence where it is shorter."""
    words = words_of(text.translate(_UPPER)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    total = h[: len(h) - n + 1] * _PLACE[0]
    for k in range(1, n):
        total = total + h[k : len(h) - n + 1 + k] * _PLACE[k]
    return np.unique(_mix(total + _U64(n)))


def samples(hashes: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """MinHash samples, one row a band."""
    least = np.full((rows, BANDS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 8192):
        x = (hashes[at : at + 8192] >> _U64(32)).astype(np.uint32)[:, None] ^ _SEEDS
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        for k in range(rows):
            np.minimum(least[k], (x * _FACTORS[k] + _OFFSETS[k]).min(axis=0), out=least[k])
    return least.T


def band_keys(sample: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * _PLACE[k] + sample[:, k].astype(np.uint64))
    return key.view(np.int64)


def odd_sketch(sample: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap of (place, sample) pairs, as longs."""
    flat = sample.ravel().astype(np.uint64)
    bit = _mix(flat + np.arange(len(flat), dtype=np.uint64) * _PLACE[15]) % _U64(bits)
    parity = np.bincount(bit.astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def most_bits(rows: int, bits: int, similarity: float = 0.8, deviations: float = 6.0) -> int:
    """Differing bits of two sketches beyond which a pair is surely less similar.

    A pair's differing samples are binomial, and each flips one bit of either
    sketch; the limit is the expected count for a similarity that lies
    ``deviations`` standard deviations below the one asked for.
    """
    n = BANDS * rows
    low = similarity - deviations * (similarity * (1 - similarity) / n) ** 0.5
    differ = 2 * n * (1 - low)
    return int(bits / 2 * (1 - np.exp(-2 * differ / bits)) + 2 * (bits / 4) ** 0.5 * (1 - np.exp(-4 * differ / bits)) ** 0.5)


def _bits(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def _sliced(batches, size: int = 500):
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            yield whole.slice(at, size)


def profiles(rows: DataFrame, size: int) -> DataFrame:
    """(id, mark, n, digest, bands, sketch) of the rows (id, mark, text)."""

    def run(batches):
        for batch in _sliced(batches):
            n, digest, bands, sketch = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, size)
                n.append(len(found))
                if len(found):
                    sample = samples(found)
                    digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(sample))
                    sketch.append(odd_sketch(sample))
                else:
                    digest.append(None)
                    bands.append(None)
                    sketch.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                names=["id", "mark", "n", "digest", "bands", "sketch"],
            )
        _words.clear()  # Python workers are used again, by other operators too

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, mark long, n long, digest binary, bands array<long>, sketch array<long>")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """(class, members): the whole shingle set of the rows (class, text)."""

    def run(batches):
        for batch in _sliced(batches):
            found = [shingles(t, size).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(found, pa.binary())], names=["class", "members"])
        _words.clear()

    return rows.select("class", "text").mapInArrow(run, "class long, members binary")


def _fine(sets: DataFrame) -> DataFrame:
    """(class, fine): finer odd sketches of shingle sets."""

    def run(batches):
        for batch in _sliced(batches):
            fine = [odd_sketch(samples(np.frombuffer(m, np.uint64), FINE_ROWS), FINE_BITS) for m in batch.column("members").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(fine, pa.list_(pa.int64()))], names=["class", "fine"])

    return sets.mapInArrow(run, "class long, fine array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("class").alias("b"), F.col("members").alias("right")), "b").join(sets.select(F.col("class").alias("a"), F.col("members").alias("left")), "a")

    def run(batches):
        for batch in _sliced(batches):
            keep = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[place] == y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _near_size(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _cells(keys: DataFrame) -> DataFrame:
    """(key, main, rest, parts, bundle) of open buckets: the largest component, blocks of the others and of it; small buckets share a bundle."""
    rest = F.ceil((F.col("size") - F.col("largest")) / BLOCK).cast("int")
    return keys.select("key", "main", rest.alias("rest"), F.ceil(F.col("largest") / BLOCK).cast("int").alias("parts"), (F.col("size") <= BLOCK).alias("bundled"))


def _pairs_within(starts: np.ndarray, sizes: np.ndarray):
    """Index pairs of all segments of at most 32 rows, segments of one size at a time."""
    for m in np.unique(sizes):
        i, j = np.triu_indices(m, 1)
        of = starts[sizes == m]
        step = max(1, PAIRS // len(i))
        for at in range(0, len(of), step):
            some = of[at : at + step, None]
            yield (some + i).ravel(), (some + j).ravel()


def _pairs_across(first: np.ndarray, second: np.ndarray):
    """Index pairs of two sides."""
    step = max(1, PAIRS // max(1, len(second)))
    for at in range(0, len(first), step):
        some = first[at : at + step]
        yield np.repeat(some, len(second)), np.tile(second, len(some))


def _pairs_among(first: np.ndarray):
    for k in range(len(first) - 1):
        yield np.full(len(first) - 1 - k, first[k]), first[k + 1 :]


def _candidates(table: pa.Table, percent: int, limit: int) -> pa.Table:
    """Pairs (a, b) of different components in the same bucket, by size, first shared band and sketch."""
    table = table.sort_by("key")
    key, ids, n, component, block = (table[c].to_numpy() for c in ("key", "class", "n", "component", "block"))
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    fine = np.stack(table["fine"].combine_chunks().to_numpy(zero_copy_only=False)).view(np.uint64)
    bands = np.stack(table["bands"].combine_chunks().to_numpy(zero_copy_only=False))
    starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    sizes = np.diff(np.append(starts, len(key)))

    def every():
        if low < high:
            yield from _pairs_across(np.flatnonzero(block == low), np.flatnonzero(block == high))
        elif low >= 0:
            yield from _pairs_among(np.arange(len(key)))
        else:
            yield from _pairs_within(starts[sizes <= 32], sizes[sizes <= 32])
            for start, size in zip(starts[sizes > 32], sizes[sizes > 32]):
                names, at, times = np.unique(component[start : start + size], return_inverse=True, return_counts=True)
                main = at == times.argmax()
                rest = start + np.flatnonzero(~main)
                yield from _pairs_across(rest, start + np.flatnonzero(main))
                yield from _pairs_among(rest)

    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in every():
        good = (component[a] != component[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        a, b = a[good], b[good]
        good = bands[a, (bands[a] == bands[b]).argmax(axis=1)] == key[a]
        a, b = a[good], b[good]
        good = np.bitwise_count(fine[a] ^ fine[b]).sum(axis=1) <= limit
        left.append(ids[a[good]])
        right.append(ids[b[good]])
    left, right = np.concatenate(left), np.concatenate(right)
    return pa.table({"a": np.minimum(left, right), "b": np.maximum(left, right)})


def _across_components(hits: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) from buckets that hold several components."""
    spark = hits.sparkSession
    members = hits.join(labels, "class", "left").select("key", "class", "n", F.coalesce("component", "class").alias("component"))
    counts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("times"))
    largest = F.max(F.struct("times", "component")).alias("top")
    keys = counts.groupBy("key").agg(largest, F.sum("times").alias("size"), F.count(F.lit(1)).alias("several")).where("several > 1")
    items = cut(members.join(_cells(keys.select("key", "size", F.col("top.times").alias("largest"), F.col("top.component").alias("main"))), "key"), small=True)
    bundles = max(shuffle_width(spark), items.count() // BUNDLE)
    block = F.when(F.col("component") == F.col("main"), F.col("rest") + F.pmod(F.xxhash64("class"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("class"), F.col("rest"))).cast("int")
    # a block of the largest component meets the blocks of the others, these meet all
    last = F.when(F.col("block") < F.col("rest"), F.col("rest") + F.col("parts")).otherwise(F.col("rest")) - 1
    other = F.explode(F.when(F.col("bundled"), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), last))).alias("other")
    dealt = items.withColumn("block", F.when(F.col("bundled"), -1).otherwise(block)).select("*", other)
    group = F.when(F.col("bundled"), F.pmod(F.xxhash64("key"), F.lit(bundles))).otherwise(F.col("key")).alias("group")
    dealt = dealt.select(group, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "key", "class", "n", "component", "block")
    fine = _fine(sets.join(items.select("class").distinct(), "class", "left_semi"))
    whole = dealt.join(fine.join(classes.select("class", "bands"), "class"), "class")
    limit = most_bits(FINE_ROWS, FINE_BITS, percent / 100)
    return whole.groupBy("group", "low", "high").applyInArrow(lambda t: _candidates(t, percent, limit), "a long, b long")


def _linked(docs: DataFrame, shingle_words: int, percent: int, text_col: str, id_col: str) -> DataFrame:
    """(id, mark, n, component, own) a row; ``mark`` tells texts of one id apart."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    profile = written(profiles(rows, shingle_words))
    first = F.min_by(F.struct("id", "mark", "n", "bands", "sketch"), F.struct("id", "mark")).alias("r")
    classes = profile.where("n > 0 and id is not null").groupBy("digest").agg(first).select(F.monotonically_increasing_id().alias("class"), "digest", "r.*")
    classes = written(classes)  # the numbers of the classes hold from here on
    bands = classes.select("class", "n", F.explode("bands").alias("key"))
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    hits = cut(bands.join(sizes, "key").select("key", "class", "n", "size"))

    popular = hits.groupBy("class").agg(F.sum("size").alias("popularity"))
    ranked = hits.join(popular, "class").select("key", "class", "n", "popularity")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("popularity", F.xxhash64("class").alias("draw"), "class", "n")).alias("h"))
    hubs = hubs.select("key", F.col("h.class").alias("hub"), F.col("h.n").alias("hub_n"))
    met = hits.join(hubs, "key").where((F.col("class") != F.col("hub")) & _near_size("n", "hub_n", percent))
    near = met.select(F.least("hub", "class").alias("a"), F.greatest("hub", "class").alias("b")).distinct()
    sketches = classes.select("class", "sketch")
    near = near.join(sketches.select(F.col("class").alias("b"), F.col("sketch").alias("y")), "b").join(sketches.select(F.col("class").alias("a"), F.col("sketch").alias("x")), "a")
    near = near.where(_bits("x", "y") <= most_bits(ROWS, SKETCH_BITS, percent / 100)).select("a", "b")

    wanted = classes.select("class", "id", "mark").join(hits.select("class").distinct(), "class", "left_semi")
    texts = rows.join(wanted, ["id", "mark"]).groupBy("id", "mark", "class").agg(F.first("text").alias("text"))
    sets = written(_sets(texts, shingle_words))
    few = max(1, shuffle_width(docs.sparkSession) // 8)  # files of the links
    links = cut(_confirmed(near, sets, percent).repartition(few))
    labels = components(links)
    more = cut(_confirmed(_across_components(hits, labels, classes, sets, percent), sets, percent).repartition(few))
    if not more.isEmpty():
        labels = components(more.unionByName(labels.select(F.col("class").alias("a"), F.col("component").alias("b"))))

    names = labels.join(classes.select("class", "id"), "class")
    names = names.join(names.groupBy("component").agg(F.min("id").alias("least")), "component").select("class", "least")
    owner = classes.select("class", "digest", "id").join(names, "class", "left").select("digest", F.coalesce("least", "id").alias("component"))
    own = F.coalesce("component", "id")
    return profile.select("id", "mark", "n", "digest").join(owner, "digest", "left").select("id", "mark", "n", own.alias("component"))


def group(docs: DataFrame, shingle_words: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 times the intersection of their shingle sets
    reaches ``percent`` times the union; component_id is the smallest id reachable.
    A document without words (null or empty text) is linked with nothing. Each row
    is a document of its own, also where an id repeats: equal rows get equal
    results, other texts of an id their own. A null id takes its class's smallest
    id if there is one. An empty table gives no rows; other columns are ignored.
    """
    found = _linked(docs, shingle_words, percent, text_col, id_col)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def deduplicate(docs: DataFrame, shingle_words: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that represent their group, all columns as they were and in their order; rows without id stay."""
    found = _linked(docs, shingle_words, percent, text_col, id_col)
    gone = found.where("id is not null and id != component").select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    return docs.join(gone, (docs[id_col] == gone["gone_id"]) & (F.xxhash64(docs[text_col]) == gone["gone_mark"]), "left_anti")
