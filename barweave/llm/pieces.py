"""SentencePiece encoding and decoding over a relational lattice.

Texts become chunks (runs of ``▁`` with the characters after them, and line breaks), no
piece crosses a chunk's end, and equal chunks have equal pieces. For the most frequent
chunks, bounded in number, the lattice is a relation: all substrings of bounded length are
exploded and equi-joined to the piece table, the edges are grouped by chunk, and a fold
with Spark's higher-order ``aggregate`` picks the path. All other chunks, the exact rest, are
encoded inside the workers by the plain form of the same fold (for ``bpe`` the merge itself,
for ``unigram`` Viterbi over the same edges), so no text moves.

The fold follows the model's kind. ``unigram``: Viterbi, the path of the highest sum of
scores. ``bpe``: the path that merging makes, highest score first; the scores of such a model
are ranks of merges, and their sums mean nothing, so Viterbi would not give its ids.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, released, stored

SPACE = "▁"
#: Chunks of the relational dictionary at most, and their longest length; with these it is small enough to broadcast.
HOT_CHUNKS = 1 << 18
HOT_LENGTH = 32
#: Distinct chunks that a worker counts before it passes the counts on.
PARTIAL_COUNTS = 1 << 18
#: Longer chunks are merged by way of a heap.
SHORT_CHUNK = 64
#: Chunks a worker remembers beside the dictionary; others are folded again each time.
CACHED_CHUNKS = 1 << 16
#: Taken off the lowest score for a character without a piece.
UNKNOWN_PENALTY = 10.0
CHUNK_PATTERN = f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+"
_EDGE = "array<struct<s:int,e:int,id:int,score:double>>"


@dataclass(frozen=True)
class Model:
    """Pieces of a SentencePiece model: ``table`` (piece -> id, score) of ordinary pieces, byte ids, and all pieces by id."""

    kind: str
    table: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    by_id: tuple[bytes, ...]

    @property
    def longest(self) -> int:
        return max(map(len, self.table), default=1)

    @property
    def unknown_score(self) -> float:
        return min((s for _, s in self.table.values()), default=0.0) - UNKNOWN_PENALTY


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; only the two kinds used here are read."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            at += 8 if tag & 7 == 1 else 4


def load(model_file: str, kind: str | None = None) -> Model:
    """Read a model file. ``kind``: bpe or unigram; the file's own unless given.

    Only models are taken that leave texts as they are (no normalisation), put ``▁`` before a
    text, have byte fallback, and have no piece across a chunk's end.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    with open(model_file, "rb") as f:
        trainer = next((v for number, v in _fields(f.read()) if number == 2), b"")
    own = next((v for number, v in _fields(trainer) if number == 3), 1)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
    table = {pieces[i]: (i, float(sp.get_score(i))) for i in range(n) if not special[i]}
    byte_ids = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    if not all(map(sp.is_byte, byte_ids)):
        raise ValueError("the model has no byte fallback")
    if any(SPACE in p.lstrip(SPACE) or ("\n" in p and p.strip("\n")) for p in table):
        raise ValueError("a piece crosses a chunk's end")
    by_id = tuple(bytes((byte_ids.index(i),)) if sp.is_byte(i) else b"" if special[i] else pieces[i].replace(SPACE, " ")
        .encode() for i in range(n))
    return Model(kind or {1: "unigram", 2: "bpe"}[own], table, byte_ids, by_id)


def marked(text: str) -> str:
    """The form that is cut into chunks: ``▁`` before the text and for each space; empty stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def edges_of(chunks: DataFrame, model: Model) -> DataFrame:
    """(chunk, n, edges): the lattice of each of the distinct ``chunks`` (chunk string).

    Substrings up to the longest piece are exploded and equi-joined to the piece table (of the
    vocabulary's fixed size, so it is broadcast). A single character without a piece is an
    edge of its own, with id -1.
    """
    spark = chunks.sparkSession
    rows = [(p, i, s) for p, (i, s) in model.table.items()]
    pieces = spark.createDataFrame(rows, "piece string, id int, score double")
    n = F.length("chunk")
    starts = F.sequence(F.lit(0), n - 1)
    spans = F.flatten(F.transform(starts,
        lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(model.longest), n - s)),
            lambda k: F.struct(s.alias("s"), (s + k).alias("e")))))
    cut = chunks.select("chunk", F.explode(spans)
        .alias("x")).select("chunk", "x.s", "x.e", F.substring("chunk", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("piece"))
    found = cut.join(F.broadcast(pieces), "piece", "left").filter(F.col("id").isNotNull() | (F.col("e") - F.col("s") == 1))
    edge = F.struct("s", "e", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(model.unknown_score)).alias("score"))
    return found.groupBy("chunk").agg(F.collect_list(edge).cast(_EDGE).alias("edges")).withColumn("n", F.length("chunk"))


def viterbi(edges: Column, n: Column) -> Column:
    """The best path as an array of (s, e, id): each place keeps its best sum and edge; of equal sums, the longest last piece."""
    begin = F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("back"), F.lit(-1).alias("id")))

    def step(best: Column, e: Column) -> Column:
        into = F.filter(edges, lambda x: x["e"] == e)
        return F.concat(best, F.array(F.array_max(F.transform(into,
            lambda x: F.struct((F.get(best, x["s"])["sum"] + x["score"]).alias("sum"), (-x["s"]).alias("back"), x["id"].alias("id"))))))

    best = F.aggregate(F.sequence(F.lit(1), n), begin, step)
    path = F.struct(n.alias("at"), F.array().cast("array<struct<s:int,e:int,id:int>>").alias("out"), best.alias("best"))

    def back(acc: Column, _: Column) -> Column:
        node = F.get(acc["best"], acc["at"])
        span = F.struct((-node["back"]).alias("s"), acc["at"].alias("e"), node["id"].alias("id"))
        return F.when(acc["at"] == 0,
            acc).otherwise(F.struct((-node["back"]).alias("at"), F.concat(F.array(span), acc["out"])
                .alias("out"), acc["best"].alias("best")))

    return F.aggregate(F.sequence(F.lit(1), n), path, back, lambda acc: acc["out"])


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once: lambdas have no names but their arguments."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged(edges: Column, n: Column) -> Column:
    """The path that merging makes: of all edges that join two neighbours, the highest score first, then the leftmost."""

    def step(bounds: Column, _: Column, joinable: Column) -> Column:
        # Neighbours' outer bounds are two places apart.
        at = lambda x: F.array_position(bounds, x["s"])
        joins = lambda x: (at(x) > 0) & (F.array_position(bounds, x["e"]) == at(x) + 2)
        best = F.array_max(F.transform(F.filter(joinable, joins),
            lambda x: F.struct(x["score"].alias("score"), (-x["s"]).alias("left"), x["e"].alias("e"))))
        return _with(best, lambda top: F.when(top.isNull(), bounds)
            .otherwise(F.filter(bounds, lambda b: (b <= -top["left"]) | (b >= top["e"]))))

    several = F.filter(edges, lambda x: x["e"] - x["s"] > 1)
    bounds = _with(several, lambda j: F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), lambda acc, i: step(acc, i, j)))
    return _with(bounds, lambda b: _spans_of(b, edges))


def _spans_of(bounds: Column, edges: Column) -> Column:
    """(s, e, id) between neighbouring bounds."""
    spans = F.zip_with(F.slice(bounds, F.lit(1), F.size(bounds) - 1), F.slice(bounds, F.lit(2), F.size(bounds) - 1), lambda s,
        e: F.struct(s.alias("s"), e.alias("e")))
    return F.transform(spans,
        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"),
            F.get(F.filter(edges, lambda y: (y["s"] == x["s"]) & (y["e"] == x["e"])), F.lit(0))["id"].alias("id")))


def segmented(chunks: DataFrame, model: Model) -> DataFrame:
    """(chunk, path): the fold of each distinct chunk's lattice."""
    fold = merged if model.kind == "bpe" else viterbi
    return edges_of(chunks, model).select("chunk", fold(F.col("edges"), F.col("n")).alias("path"))


def plain(text: str) -> bool:
    """Is the text cut at single spaces and line breaks alone? Then no pattern is needed."""
    return bool(text) and not (text[0] in " \n" or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or SPACE in text)


def hot_chunks(docs: DataFrame) -> DataFrame:
    """The most frequent chunks of the whole corpus, at most HOT_CHUNKS of them.

    Counts cover every text; workers pass on partial counts, of bounded number at a time. Where
    the hot ones end is found from counts of counts in fine steps, so nothing is sorted and at
    most a thousand numbers reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile(CHUNK_PATTERN).findall
        inner: Counter[str] = Counter()
        other: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            rows = [(SPACE + w, n) for w, n in inner.items() if len(w) < HOT_LENGTH] + [(c, n) for c, n in other.items()
                if len(c) <= HOT_LENGTH]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()),
                pa.array([n for _, n in rows], pa.int64())], names=["chunk", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                if not plain(text):
                    other.update(cut(marked(text)))
                    continue
                first, *lines = text.split("\n")
                inner.update(first.split(" "))
                for line in lines:
                    if line:
                        words = line.split(" ")
                        other[words[0]] += 1
                        inner.update(words[1:])
            if len(inner) + len(other) > PARTIAL_COUNTS:
                yield counted()
                inner.clear()
                other.clear()
        yield counted()

    partial = map_batches(docs.select("text"), run, "chunk string, n long")
    counts = stored(partial.groupBy("chunk").agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
        .withColumn("step", F.floor(F.log(F.col("n").cast("double")) * 32).cast("int")))
    least, held = None, 0
    for step, n in sorted(((r["step"], r["n"]) for r in counts.groupBy("step").agg(F.count("*").alias("n")).collect()), reverse=True):
        held += n
        if held > HOT_CHUNKS:
            break
        least = step
    return counts.filter(F.lit(False) if least is None else F.col("step") >= least).select("chunk")


class Encoder:
    """The lattice and fold inside a worker, with a dictionary of chunks that are already folded."""

    def __init__(self, model: Model, inner: dict[str, bytes] | None = None, other: dict[str, bytes] | None = None):
        """``inner``.

        Ids of chunks that begin with ``▁``, named without it; ``other``: of all other chunks. Both are taken over,
        not copied.
        """
        self.model = model
        self.cut = re.compile(CHUNK_PATTERN).findall
        self.bytes_of = np.array(model.by_id, dtype=object)
        self.scores = {p: s for p, (_, s) in model.table.items()}
        self.ids = {p: i for p, (i, _) in model.table.items()}
        self.line_break = self.packed("\n", self.path("\n"))
        self.inner = {} if inner is None else inner
        self.other = {} if other is None else other
        self.added = 0

    def _missing(self, held: dict[str, bytes], key: str, chunk: str) -> bytes:
        got = self._folded(chunk)
        if len(chunk) <= 64 and self.added < CACHED_CHUNKS:
            held[key] = got
            self.added += 1
        return got

    def path(self, chunk: str) -> list[tuple[int, int, int]]:
        """(s, e, id) of the chunk's pieces; id -1 for a character without one."""
        return (self._merged if self.model.kind == "bpe" else self._viterbi)(chunk)

    def _viterbi(self, chunk: str) -> list[tuple[int, int, int]]:
        table, n, unknown = self.model.table, len(chunk), self.model.unknown_score
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        longest = self.model.longest
        for e in range(1, n + 1):
            top = None
            for s in range(max(0, e - longest), e):
                found = table.get(chunk[s:e])
                if found is None and e - s > 1:
                    continue
                i, score = found or (-1, unknown)
                total = best[s][0] + score
                if top is None or total > top[0]:
                    top = (total, s, i)
            best.append(top)
        out, at = [], n
        while at:
            _, s, i = best[at]
            out.append((s, at, i))
            at = s
        return out[::-1]

    def _folded(self, chunk: str) -> bytes:
        """The packed ids of a chunk."""
        if self.model.kind == "bpe":
            try:
                return array("i", [self.ids[p] for p in self._parts(chunk)]).tobytes()
            except KeyError:  # a character without a piece
                pass
        return self.packed(chunk, self.path(chunk))

    def _parts(self, chunk: str) -> list[str]:
        """The strings that merging leaves."""
        if len(chunk) > SHORT_CHUNK:
            return self._parts_of_long(chunk)
        get, none = self.scores.get, float("-inf")
        parts = list(chunk)
        score = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while score:
            top = max(score)
            if top == none:
                break
            i = score.index(top)
            joined = parts[i] + parts[i + 1]
            parts[i] = joined
            del parts[i + 1], score[i]
            if i:
                score[i - 1] = get(parts[i - 1] + joined, none)
            if i < len(score):
                score[i] = get(joined + parts[i + 1], none)
        return parts

    def _parts_of_long(self, chunk: str) -> list[str]:
        """The same for a long chunk, in time n log n: possible merges wait in a heap, parts are linked to their neighbours."""
        get, n = self.scores.get, len(chunk)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0: no part starts here any more
        before = list(range(-1, n - 1))
        heap = [(-score, i, i + 2) for i in range(n - 1) if (score := get(chunk[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, start, stop = heappop(heap)
            middle = end[start]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of its parts has been merged since
            end[start], end[middle] = stop, 0
            if stop < n:
                before[stop] = start
                score = get(chunk[start : end[stop]])
                if score is not None:
                    heappush(heap, (-score, start, end[stop]))
            if start:
                left = before[start]
                score = get(chunk[left:stop])
                if score is not None:
                    heappush(heap, (-score, left, stop))
        out, at = [], 0
        while at < n:
            out.append(chunk[at : end[at]])
            at = end[at]
        return out

    def _merged(self, chunk: str) -> list[tuple[int, int, int]]:
        out, at = [], 0
        for p in self._parts(chunk):
            out.append((at, at + len(p), self.ids.get(p, -1)))
            at += len(p)
        return out

    def packed(self, chunk: str, path: list[tuple[int, int, int]]) -> bytes:
        """The ids of a path, characters without a piece as bytes, as 32 bit numbers."""
        ids: list[int] = []
        for s, e, i in path:
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(self.model.byte_ids[b] for b in chunk[s:e].encode("utf-8", "surrogatepass"))
        return array("i", ids).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text."""
        inner, other, missing = self.inner, self.other, self._missing
        out: list[bytes] = []
        if not text or not plain(text):
            for chunk in self.cut(marked(text or "")):
                held, key = (inner, chunk[1:]) if chunk[0] == SPACE else (other, chunk)
                out.append(held.get(key) or missing(held, key, chunk))
        else:
            for k, line in enumerate(text.split("\n")):
                words = line.split(" ")
                if k:
                    out.append(self.line_break)
                    if not line:
                        continue
                    first = words.pop(0)
                    out.append(other.get(first) or missing(other, first, first))
                got = list(map(inner.get, words))
                if None in got:
                    got = [ids or missing(inner, w, SPACE + w) for w, ids in zip(words, got)]
                out += got
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, ``▁`` as spaces, without the leading one."""
        text = b"".join(self.bytes_of[ids].tolist()).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _dictionary(docs: DataFrame, model: Model) -> tuple[dict[str, bytes], dict[str, bytes]]:
    """Ids of the hot chunks, by the relational lattice: those after a space, without their mark, and others. Of bounded size."""
    got = segmented(hot_chunks(docs), model).toArrow()
    pack = Encoder(model).packed
    inner: dict[str, bytes] = {}
    other: dict[str, bytes] = {}
    for batch in got.to_batches(max_chunksize=4096):  # as Python objects, only some paths at a time
        for c, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held, key = (inner, c[1:]) if c[0] == SPACE else (other, c)
            held[key] = pack(c, [(x["s"], x["e"], x["id"]) for x in path])
    return inner, other


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every row's whole text.

    ``round_trip``: do the ids decode to the text again (``▁`` in a text decodes as a space). A
    null or empty text has no ids and a true round trip; a null doc_id stays null; repeated
    rows stay repeated; other columns are ignored.
    """
    inner, other = _dictionary(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, inner, other)  # the task's own copies
        released()  # what reading them took
        for batch in batches:
            ids, same = [], []
            for text in batch.column(1).to_pylist():
                ids.append(encoder.encode(text))
                same.append(encoder.decode(ids[-1]) == (text or "").replace(SPACE, " "))
            sizes = np.array([len(x) for x in ids], np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.r_[0, sizes.cumsum()].astype(np.int32)),
                pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), flat, pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "ids", "round_trip"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
        "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text, null or foreign ids within count as nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        top = len(model.by_id)
        for batch in batches:
            texts = [None if x is None else encoder.decode(np.array([i for i in x if i is not None and 0 <= i < top], np.int64))
                for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")
