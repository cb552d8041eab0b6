"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

1. Equal sets are one class, by digest; all that follows works on classes.
2. A set can only link if 80 % of its shingles occur in another set. Of the shingles with a
   small hash, the same ones for all sets, at most the fifth that may differ can then be
   without another set. These, packed by hash bucket, are checked for that; the rest of the
   classes is done. Those that are left are checked once more, with all their shingles.
3. Candidates, by token-combination prefixes. Shingles are ordered rare class first, frequent
   class last. Two linked sets share, within their first p shingles, their first common
   one; if it is rare, it is a key of both. If it is frequent, so are all common ones, and
   within prefixes extended to 2p there are two common ones that are at most ``GAP``
   places apart in both: pairs of frequent shingles that close are keys.
4. Pairs of sets that share a key of few sets are tried by their sizes and by parity bits that
   never show too many differences; a key of many sets joins all of them. Sets joined so,
   directly or through others, form clusters; large ones are split by sketches that never
   count too few common shingles. Clusters are verified in tiles of bounded size, by products
   of incidence matrices; the links' components follow.

Why GAP is 5: with p(n) = n - ceil(0.8 n) + 1, linked sets share at least K of their first
p + K - 1 shingles. Take K = 1 + min(p, q) for prefixes p and q, p <= 2q. The K - 1 steps
between neighbouring common shingles fill fewer than p + q places in either set, so fewer
than half of them are longer than 5 in either, and one is short in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored
from .components import components

#: Words of a shingle, and the least similarity in hundredths.
WIDTH = 5
PERCENT = 80
GAP = 5
#: Share of the hash range whose shingles are checked for occurrence in several sets.
CHECKED = 0.45
#: Shingles of a bucket that is checked for occurrence in several sets.
BUCKET = 1_500_000
#: Classes whose counts are added up in one task.
GROUP = 50_000
#: A shingle is of the frequent class if it was counted more often than this; doubled until at most MAX_FREQUENT are.
FREQUENT = 32
MAX_FREQUENT = 1 << 20
#: Shingles counted at once in a task; those met once in such a chunk aren't passed on, which only affects the classes.
CHUNK = 2_000_000
#: Bits of the filter by which a task skips texts that no class needs.
FILTER_BITS = 23
#: Sets of a tile: a 32nd of its cluster, within these.
TILE = (128, 4096)
#: Clusters of more sets than this are split by sketches first, which have so many counters; keys of more aren't tried by pairs.
LARGE = 64
COUNTERS = 256
#: Cells of an incidence matrix held at once.
CELLS = 1 << 23

#: Bytes of texts whose shingles are made at once, so that all arrays of it stay in a core's cache.
PIECE = 1 << 16
#: Longer words, in bytes, are hashed one by one.
LONG_WORD = 64

_RNG = np.random.default_rng(20240229)
_STEP = _RNG.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IN_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: By the number of a word's bytes in a chunk of eight: those bytes.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bit hashes of the words between ``begin`` and ``end``, eight bytes at a time."""
    size = end - begin
    chunks = np.ndarray(len(raw), "<u8", raw + bytes(8), strides=(1,))  # at every byte, the eight from there
    out = _mixed(size.astype(np.uint64) * _STEP[0])
    some = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        some = some[size[some] > at]
        if not len(some):
            break
        part = chunks[begin[some] + at] & _KEPT[np.minimum(size[some] - at, 8)]
        out[some] = _mixed((out[some] ^ part) * _STEP[1])
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(raw[begin[i] : end[i]], digest_size=8).digest(), "little")
    return out


def _piece(raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts): the shingles of the texts that begin at ``starts``, text by text, each text's sorted and distinct."""
    n = len(starts)
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = _IN_WORD[np.frombuffer(raw, np.uint8)]
    inner = starts[(starts > 0) & (starts < len(raw))]
    first, last = word[1:] & ~word[:-1], word[:-1] & ~word[1:]
    first[inner], last[inner] = word[inner + 1], word[inner]  # a word ends where its text does
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    of = np.searchsorted(starts, begin, "right") - 1
    words, sizes = _words(raw, begin, end), np.bincount(of, minlength=n)
    at = np.cumsum(sizes) - sizes
    counts = np.where(sizes < WIDTH, np.minimum(sizes, 1), sizes - WIDTH + 1)
    place = np.cumsum(counts) - counts
    tokens = np.zeros(counts.sum(), np.uint64)
    if len(words) >= WIDTH:
        m = len(words) - WIDTH + 1
        total = words[:m] * _STEP[0]
        for j in range(1, WIDTH):
            total += words[j : m + j] * _STEP[j]
        tokens[np.repeat(sizes >= WIDTH, counts)] = _mixed(total[of[:m] == of[WIDTH - 1 :]] + np.uint64(WIDTH))
    for width in range(1, WIDTH):
        few = np.flatnonzero(sizes == width)
        if len(few):
            tokens[place[few]] = _mixed((words[at[few][:, None] + np.arange(width)] * _STEP[:width]).sum(1) + np.uint64(width))
    for i, to in zip(place.tolist(), (place + counts).tolist()):
        tokens[i:to].sort()
    owner = np.repeat(np.arange(n), counts)
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[new], np.bincount(owner[new], minlength=n)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct 64 bit hashes of shingles; those of many short texts are made together.

    A-Z are lower-cased and words end at ASCII white space. With fewer words than a shingle
    has, the whole sequence is one; without words there is none.
    """
    column = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return []
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2] or pa.py_buffer(b"")
    out: list[np.ndarray] = []
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
        raw = data[int(ends[at]) : int(ends[to])].to_pybytes().lower()
        tokens, counts = _piece(raw, ends[at:to] - ends[at])
        upto = np.cumsum(counts).tolist()
        out += [tokens[i:j] for i, j in zip([0, *upto], upto)]
        at = to
    return out


def shingles(text: str | None) -> np.ndarray:
    """The set of one text."""
    return shingle_sets(pa.array([(text or "").encode("utf-8", "surrogatepass")], pa.binary()))[0]


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def need(n):
    """The least number of a set's shingles that a linked set shares: the ceiling of 0.8 n."""
    return -(-n * PERCENT // 100)


def _sized(docs: DataFrame) -> DataFrame:
    """(doc_id, n, c, d, e): size, checked shingles and digest of every row's set; nulls for the digest of an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            marks = [digest(s) if len(s) else (None, None) for s in sets]
            columns = [[len(s) for s in sets], [len(checked(s)) for s in sets], [m[0] for m in marks], [m[1] for m in marks]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "n", "c", "d", "e"])

    return map_batches(docs, run, "doc_id long, n long, c long, d long, e long")


def checked(tokens: np.ndarray) -> np.ndarray:
    """The shingles that are checked for other sets: those with the highest bits below a bound, alike for all sets."""
    return tokens[: np.searchsorted(tokens, np.uint64(int(CHECKED * 2.0**32) << 32))]


def _multiplicities(marks: np.ndarray, places: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, shingles): for each class, its shingles at all places.

    Different shingles of a class can fall on one place, and a class comes in several rows; it
    has as many there as its fullest row, so none is counted too little.
    """
    order = np.lexsort((rows, places, marks))
    marks, places, rows = marks[order], places[order], rows[order]
    if not len(marks):
        return marks, np.zeros(0, np.int64)
    new_place = np.r_[True, (marks[1:] != marks[:-1]) | (places[1:] != places[:-1])]
    starts = np.flatnonzero(new_place | np.r_[True, rows[1:] != rows[:-1]])
    counts = np.diff(np.r_[starts, len(marks)])
    most = np.maximum.reduceat(counts, np.flatnonzero(new_place[starts]))
    found, place = np.unique(marks[new_place], return_inverse=True)
    return found, np.bincount(place, most).astype(np.int64)


def _packed(sets: dict[int, np.ndarray], n_buckets: int) -> pa.RecordBatch | None:
    """(bucket, marks, counts, tokens): shingles of several classes by bucket of their hash, one row a bucket, 32 bits each."""
    tokens = np.concatenate([np.zeros(0, np.uint64), *sets.values()])
    if not len(tokens):
        return None
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), [len(t) for t in sets.values()])
    bucket = (_mixed(tokens) >> np.uint64(32)).astype(np.int64) * n_buckets >> 32
    bucket = bucket.astype(np.uint16) if n_buckets <= 1 << 16 else bucket  # short numbers are sorted by digits
    order = np.argsort(bucket, kind="stable")
    tokens, owner, bucket = (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], owner[order], bucket[order]
    marks = np.array(list(sets), np.int64)
    run = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])])  # a class in a bucket
    who, counts = marks[owner[run]], np.diff(np.r_[run, len(tokens)]).astype(np.uint32)
    used, first = np.unique(bucket[run], return_index=True)
    rows = []
    for b, at, to in zip(used, first, np.r_[first[1:], len(run)]):
        upto = run[to] if to < len(run) else len(tokens)
        rows.append((int(b), who[at:to].tobytes(), counts[at:to].tobytes(), tokens[run[at] : upto].tobytes()))
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
        names=["bucket", "marks", "counts", "tokens"])


_PACKED = "bucket long, marks binary, counts binary, tokens binary"


def _packed_texts(docs: DataFrame, n_buckets: int) -> DataFrame:
    """The checked shingles of all texts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, np.ndarray] = {}
            for tokens in shingle_sets(batch.column(1)):
                if len(tokens):
                    seen[digest(tokens)[0]] = checked(tokens)
            made = _packed(seen, n_buckets)
            if made is not None:
                yield made

    return map_batches(docs, run, _PACKED)


def _packed_sets(sets: DataFrame, n_buckets: int) -> DataFrame:
    """All shingles of the given sets (d, tokens), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {d: np.frombuffer(t, np.uint64) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
            made = _packed(held, n_buckets)
            if made is not None:
                yield made

    return map_batches(sets.select("d", "tokens"), run, _PACKED)


def _shared_counts(packed: DataFrame, n_groups: int) -> DataFrame:
    """(d, shared): of each class, how many of its packed shingles another class has too.

    Shingles are compared by bucket and 32 bits: ``shared`` may be too large, never too small. A
    class that shares none is missing.
    """

    def check(key: tuple, table: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        marks = np.repeat(joined("marks", np.int64), joined("counts", np.uint32))
        tokens = joined("tokens", np.uint32)
        sizes = [len(t) // 4 for t in table.column("tokens").to_pylist()]
        rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.sort(tokens.astype(np.uint64) << np.uint64(32) | np.arange(len(tokens), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
        order = order.astype(np.int64)  # as a stable argsort has it, at a part of its time
        tokens, marks, rows = tokens[order], marks[order], rows[order]
        start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        low, high = np.minimum.reduceat(marks, start), np.maximum.reduceat(marks, start)
        size = np.diff(np.r_[start, len(tokens)])
        several = np.repeat(low != high, size)
        found, counts = _multiplicities(marks[several], np.repeat(np.arange(len(start)), size)[several], rows[several])
        group = (found.view(np.uint64) % np.uint64(n_groups)).astype(np.int64)
        used = np.unique(group)
        blobs = [(found[group == g].tobytes(), counts[group == g].astype(np.uint32).tobytes()) for g in used]
        return pa.table({"part": pa.array(used, pa.int64()), "marks": pa.array([b[0] for b in blobs], pa.binary()),
            "counts": pa.array([b[1] for b in blobs], pa.binary())})

    def add(key: tuple, table: pa.Table) -> pa.Table:
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.int64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
        found, place = np.unique(marks, return_inverse=True)
        return pa.table({"d": pa.array(found, pa.int64()), "shared": pa.array(np.bincount(place, counts).astype(np.int64), pa.int64())})

    parts = packed.groupBy("bucket").applyInArrow(check, "part long, marks binary, counts binary")
    return parts.groupBy("part").applyInArrow(add, "d long, shared long")


def _needed_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(d, n, tokens): the sets of the given classes (d, e, first), each from the document ``first``.

    Texts that no class needs are told by a filter of bounded size before their sets move.
    """
    mask = (1 << FILTER_BITS) - 1
    slot = F.col("d").bitwiseXOR(F.col("first")).bitwiseAND(F.lit(mask))
    bits = classes.select(slot.alias("s")).groupBy(F.shiftright("s", 5)
        .alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("bits"))
    table = np.zeros((mask + 1) // 32, np.int64)
    got = bits.toArrow()  # 2^18 numbers at most
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, tokens in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1))):
                if key is not None and len(tokens):
                    d, e = digest(tokens)
                    s = (d ^ key) & mask
                    if table[s >> 5] >> (s & 31) & 1:
                        rows.append((key, d, e, len(tokens), tokens.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t)
                    for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                        names=["first", "d", "e", "n", "tokens"])

    found = map_batches(docs, run, "first long, d long, e long, n long, tokens binary")
    return found.join(classes.select("d", "e", "first"), ["d", "e", "first"]).groupBy("d").agg(F.first("n")
        .alias("n"), F.first("tokens").alias("tokens"))


def _only_shared(sets: DataFrame) -> DataFrame:
    """The sets whose shingles, all of them, are to 80 % in another of the sets: they are few by now, so the whole check is small."""
    total, n = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shared = _shared_counts(_packed_sets(sets, max(1, -(-total // BUCKET))), max(1, -(-n // GROUP)))
    fit = stored(sets.select("d", "n").join(shared, "d").filter(F.col("shared") * 100 >= F.col("n") * PERCENT).select("d"))
    return stored(sets.join(fit, "d"))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles by hash. Two sets share at most the sum of the smaller counts."""
    return np.bincount(((tokens >> np.uint64(20)) % np.uint64(COUNTERS))
        .astype(np.int64), minlength=COUNTERS).astype(np.uint16 if len(tokens) < 65536 else np.uint32)


def _frequent(sets: DataFrame) -> np.ndarray:
    """Shingles of the frequent class, the most frequent last; at most MAX_FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            several = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[several].view(np.int64)), pa.array(counts[several].astype(np.int64))],
                names=["token", "n"])

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(np.frombuffer(blob, np.uint64))
                size += len(held[-1])
                if size >= CHUNK:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    counts = stored(map_batches(sets.select("tokens"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        .filter(F.col("n") > FREQUENT))
    least = FREQUENT
    while counts.filter(F.col("n") > least).count() > MAX_FREQUENT:
        least *= 2
    got = counts.filter(F.col("n") > least).toArrow()
    tokens, n = got.column("token").to_numpy().view(np.uint64), got.column("n").to_numpy()
    return tokens[np.lexsort((tokens, n))]


def prefix_keys(tokens: np.ndarray, rank: "Ranks") -> np.ndarray:
    """A set's keys: rare shingles of its prefix, and near pairs of frequent ones of the extended prefix."""
    n = len(tokens)
    p = n - need(n) + 1
    place = rank(tokens)
    rare = tokens[place < 0]  # already by value
    frequent = tokens[place >= 0][np.argsort(place[place >= 0])]
    rest = frequent[: max(0, min(n, 2 * p) - len(rare))]
    keys = [rare[:p]]
    for gap in range(1, min(GAP, len(rest) - 1) + 1):
        a, b = rest[:-gap], rest[gap:]
        keys.append(_mixed(np.minimum(a, b) * np.uint64(0x9E3779B97F4A7C15) + _mixed(np.maximum(a, b))))
    return np.concatenate(keys)


class Ranks:
    """Places of frequent shingles in the common order; -1 for rare ones."""

    def __init__(self, frequent: np.ndarray):
        order = np.argsort(frequent)
        self.tokens, self.places = frequent[order], order

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.places[at], -1)


def parities(tokens: np.ndarray) -> np.ndarray:
    """As many bits as a set has shingles, rounded up to a power of two: each tells whether an odd number of them fall on it.

    Every shingle that only one of two sets has turns one bit, so sets differ in at least as many shingles as in bits.
    """
    size = 1 << max(6, (len(tokens) - 1).bit_length())
    counts = np.bincount((tokens >> np.uint64(16)).astype(np.int64) & (size - 1), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that may link by their sets' parities: no link is lost."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1),
                pa.array([parities(np.frombuffer(t, np.uint64)).tobytes() for t in batch.column(2).to_pylist()], pa.binary())],
                    names=["node", "n", "bits"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            bits = [batch.column(c).to_pylist() for c in (4, 5)]
            long = np.array([[len(x) // 8 for x in side] for side in bits], np.int64).reshape(2, -1)
            apart = np.zeros(len(total), np.int64)
            for x, y in np.unique(long.T, axis=0):
                at = np.flatnonzero((long[0] == x) & (long[1] == y))
                least = min(x, y)
                one, other = (np.bitwise_xor.reduce(np.frombuffer(b"".join([side[i] for i in at]), np.uint64)
                    .reshape(len(at), -1, least), axis=1) for side in bits)  # longer ones are folded
                apart[at] = np.bitwise_count(one ^ other).sum(1)
            # Sets of which at most c are common and total - 2c differ link if 100 c >= 80 (total - c).
            common = (total - apart) // 2
            keep = pa.array(100 * common >= PERCENT * (total - common))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    drawn = stored(map_batches(sets.select("d", "n", "tokens"), draw, "node long, n long, bits binary"))
    of = lambda x: drawn.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    return map_batches(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), check,
        "a long, b long")


def _clusters(sets: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(node, root): classes that share a key and may link, directly or through others.

    Sets of a key of few sets are tried pair by pair, so that keys that sets share by chance don't chain them; a key of
    more than LARGE sets joins all of its sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = Ranks(frequent)
        for batch in batches:
            keys = [prefix_keys(np.frombuffer(blob, np.uint64), rank) for blob in batch.column(2).to_pylist()]
            if keys:
                times = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)),
                    *(pa.array(np.repeat(batch.column(i).to_numpy(), times)) for i in (0, 1))], names=["key", "node", "n"])

    keyed = map_batches(sets.select("d", "n", "tokens"), run, "key long, node long, n long")
    least = stored(keyed.groupBy("key").agg(F.min("node").alias("m"), F.max("node").alias("most"), F.count("*").alias("size"))
        .filter(F.col("m") < F.col("most")).select("key", "m", "size"))
    shared = stored(keyed.join(least, "key"))
    few = shared.filter(F.col("size") <= LARGE).select("key", "node", "n")
    other = few.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"))
    fits = (F.col("n") * PERCENT <= F.col("n_b") * 100) & (F.col("n_b") * PERCENT <= F.col("n") * 100)
    pairs = few.join(other, "key").filter((F.col("node") < F.col("b")) & fits).select(F.col("node").alias("a"), "b").distinct()
    stars = shared.filter((F.col("size") > LARGE) & (F.col("node") != F.col("m"))).select(F.col("m").alias("a"), F.col("node")
        .alias("b")).distinct()
    return components(_likely(stored(pairs), sets).unionByName(stars))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of another."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    tokens, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    keep = counts[place] > 1
    column = np.cumsum(counts > 1) - 1
    row, place = row[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    n_columns, width = int((counts > 1).sum()), max(1, CELLS // (len(left) + len(right)))
    for at in range(0, n_columns, width):
        lo, hi = np.searchsorted(place, [at, at + width])
        cells = np.zeros((len(left) + len(right), min(width, n_columns - at)), np.float32)
        cells[row[lo:hi], place[lo:hi] - at] = 1
        out += cells[: len(left)] @ cells[len(left) :].T
    return out.astype(np.int64)


def _tile_pairs(items: DataFrame, clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """``items`` (with node) dealt over the pairs of tiles (i, j) of their cluster (root); tile tells which one an item is in."""
    side = F.least(F.greatest(F.ceil(F.col("m") / 32), F.lit(TILE[0])), F.lit(TILE[1]))
    tiled = clusters.join(stored(sizes.withColumn("tiles", F.ceil(F.col("m") / side).cast("int")).select("root", "tiles")), "root")
    placed = tiled.select("node", "root", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"))
    dealt = items.join(placed, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select("root", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", *items.columns)


def _least_labels(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The least node that each node reaches over the links between the rows ``a`` and ``b``."""
    root, big = nodes.copy(), np.iinfo(np.int64).max
    while True:
        old = root.copy()
        root[a] = np.minimum(root[a], np.where(linked, root[b][None, :], big).min(1))
        root[b] = np.minimum(root[b], np.where(linked, root[a][:, None], big).min(0))
        if (old == root).all():
            return root


def _split(sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters again, the large ones split where sketches show that sets can't link.

    No link is lost, as sketches never count too little.
    """
    sizes = stored(clusters.groupBy("root").agg(F.count("*").alias("m")))
    large = sizes.filter(F.col("m") > LARGE)
    if not large.limit(1).count():
        return clusters
    inside = stored(clusters.join(large.select("root"), "root").select("node", "root"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1),
                pa.array([sketch(np.frombuffer(t, np.uint64)).tobytes() for t in batch.column(2).to_pylist()], pa.binary())],
                    names=["node", "n", "sketch"])

    def check(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        tile, nodes, n = (table.column(c).to_numpy() for c in ("tile", "node", "n"))
        drawn = np.stack([np.frombuffer(b, np.uint16 if len(b) == 2 * COUNTERS else np.uint32)
            .astype(np.int32) for b in table.column("sketch").to_pylist()], 1)
        a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        if not len(a) or not len(b):
            return pa.table({"node": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        common = np.zeros((len(a), len(b)), np.int32)
        for row in drawn:
            common += np.minimum(row[a][:, None], row[b][None, :])
        linked = 100 * common >= PERCENT * (n[a][:, None] + n[b][None, :] - common)
        if i == j:
            np.fill_diagonal(linked, False)
        root = _least_labels(nodes, a, b, linked)
        return pa.table({"node": pa.array(nodes[root < nodes], pa.int64()), "root": pa.array(root[root < nodes], pa.int64())})

    drawn = map_batches(sets.join(inside.select(F.col("node").alias("d")), "d")
        .select("d", "n", "tokens"), draw, "node long, n long, sketch binary")
    pairs = _tile_pairs(drawn, inside, large)
    # Written first: a task that checks and contracts at once would hold two workers.
    split = components(stored(pairs.groupBy("root", "i", "j").applyInArrow(check, "node long, root long")))
    return stored(clusters.join(sizes.filter(F.col("m") <= LARGE).select("root"), "root").select("node", "root").unionByName(split))


def _verified(sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node, root, links): for each tile pair of a node's cluster, the least node it is linked to there and how many documents."""
    sizes = clusters.groupBy("root").agg(F.count("*").alias("m"))
    pairs = _tile_pairs(sets.select(F.col("d").alias("node"), "copies", "tokens"), clusters, sizes)

    def check(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        tile, nodes, copies = (table.column(c).to_numpy() for c in ("tile", "node", "copies"))
        sets_ = [np.frombuffer(b, np.uint64) for b in table.column("tokens").to_pylist()]
        a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        n = np.array([len(s) for s in sets_])
        links, root = np.zeros(len(nodes), np.int64), nodes.copy()
        if len(a) and len(b):
            common = overlaps([sets_[x] for x in a], [sets_[x] for x in b])
            linked = 100 * common >= PERCENT * (n[a][:, None] + n[b][None, :] - common)
            if i == j:
                np.fill_diagonal(linked, False)
                links[a] = linked @ copies[a]
            else:
                links[a], links[b] = linked @ copies[b], copies[a] @ linked
            root = _least_labels(nodes, a, b, linked)
        return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(root, pa.int64()), "links": pa.array(links, pa.int64())})

    return pairs.groupBy("root", "i", "j").applyInArrow(check, "node long, root long, links long")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs``.

    ``component_id``: the smallest doc_id reachable over links, its own included;
    ``n_links``: how many other rows it links with. Texts that are null or without words have
    no shingles, link with nothing and are their own component; so are, with a null
    component_id, rows without a doc_id. Rows that repeat a doc_id are rows of their own.
    Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sized = stored(_sized(texts))
    named = sized.filter(F.col("doc_id").isNotNull() & F.col("d").isNotNull())
    classes = stored(named.groupBy("d", "e")
        .agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.max("c").alias("c"), F.count("*").alias("copies")))
    total, n_classes = classes.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    keyed = texts.filter(F.col("doc_id").isNotNull())
    shared = _shared_counts(_packed_texts(keyed, max(1, -(-total // BUCKET))), max(1, -(-n_classes // GROUP)))
    alone = F.col("n") - F.ceil(F.col("n") * PERCENT / 100)  # so many shingles of a set that links may be without another set
    able = classes.join(shared, "d", "left").filter(F.col("c") - F.coalesce("shared", F.lit(0)) <= alone)
    able = stored(able.select("d", "e", "first", "copies"))
    sets = _only_shared(stored(_needed_sets(keyed, able).join(able.select("d", "copies"), "d")))
    checked = stored(_verified(sets, _split(sets, _clusters(sets, _frequent(sets)))))
    roots = components(checked.filter(F.col("node") != F.col("root")).select("node", "root"))
    linked = checked.groupBy(F.col("node").alias("d")).agg(F.sum("links").alias("links"))
    grouped = roots.join(classes.select(F.col("d").alias("node"), "first"), "node")
    least = stored(grouped.groupBy("root").agg(F.min("first").alias("component")))
    of_class = stored(roots.join(least, "root").select(F.col("node").alias("d"), "component"))
    known = stored(classes.join(of_class, "d", "left").join(linked, "d", "left")
        .select("d", "e", F.coalesce("component", "first")
            .alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = sized.join(known, ["d", "e"], "left")
    return out.select("doc_id", F.col("n")
        .alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
            .alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
                .alias("n_links"))
