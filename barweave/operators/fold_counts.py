"""What discoveries on several windows need of all states and pairs of states, from one pass over rows packed to bits.

States of all folds are bits of the same row: base states once, quantile states once a fold. Windows are unions of spans of
days, and a day is in a window whole, so sums by day serve every window; no row is repeated a window or a pattern.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pattern_counts import _chunks, _numbers, _outcome, _states, Products, RANGES, robust

#: Patterns whose days are put together at once.
CHUNK = 64
_EPOCH = date(1970, 1, 1)


@dataclass(frozen=True)
class Span:
    """A window: its first and last day, and the places of its fold's patterns among all."""

    first: date
    last: date
    patterns: tuple[int, ...] = ()

    @property
    def days(self) -> tuple[int, int]:
        """As numbers, the last one exclusive."""
        return (self.first - _EPOCH).days, (self.last - _EPOCH).days + 1


def within(df: DataFrame, spans: list[Span]) -> DataFrame:
    """Rows of a day that is in any window."""
    inside = F.lit(False)
    for s in spans:
        inside = inside | F.col("date").between(F.lit(s.first), F.lit(s.last))
    return df.filter(inside)


def _days(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return _numbers(table, "date", "datetime64[D]").astype(np.int64)


def _signs(x: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
    return [known, known * (x > 0), known * (x < 0)]


def _parts(spans: list[Span]) -> tuple[np.ndarray, list[np.ndarray]]:
    """First days of the parts that windows are made of, and a mask of those parts for each window."""
    edges = np.unique([d for s in spans for d in s.days])
    return edges, [(edges >= s.days[0]) & (edges < s.days[1]) for s in spans]


def quantiles(df: DataFrame, columns: list[str], spans: list[Span], at: list[float]) -> list[dict[str, tuple[int, list[float | None]]]]:
    """By window and column: count and exact nearest-rank quantiles, nulls and NaN left out.

    A column's values are counted by range and part of the windows; only those in the ranges that hold a quantile are shuffled.
    """
    value = [F.col(c).cast("double") for c in columns]
    known = within(df, spans).select("date", *(F.when(~F.isnan(v), v).alias(f"v{i}") for i, v in enumerate(value)))
    cuts = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    got = known.agg(*(F.percentile_approx(f"v{i}", cuts, F.lit(2000)).alias(f"q{i}") for i in range(len(columns)))).first()
    ranges = [np.unique(np.array(got[f"q{i}"] or [], np.float64)) for i in range(len(columns))]
    edges, inside = _parts(spans)

    def placed(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = _numbers(batch, f"v{i}")
        there = ~np.isnan(v)
        return v[there], np.searchsorted(ranges[i], v[there], "right"), np.searchsorted(edges, _days(batch)[there], "right") - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(columns), len(edges) * RANGES), np.int64)
        for batch in batches:
            for i in range(len(columns)):
                _, place, part = placed(batch, i)
                n[i] += np.bincount(part * RANGES + place, minlength=n.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(columns)), pa.int32()), pa.array([c.tobytes() for c in n], pa.binary())],
            names=["i", "counts"])

    counted = known.mapInArrow(count, "i int, counts binary").groupBy("i").applyInArrow(_added("i"), "i int, counts binary")
    counts = {r["i"]: np.frombuffer(r["counts"], np.int64).reshape(len(edges), RANGES) for r in counted.collect()}  # a row a column
    out: list[dict[str, tuple[int, list[float | None]]]] = [{c: (0, [None] * len(at)) for c in columns} for _ in spans]
    asked: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for i, by_part in counts.items():
        for w in range(len(spans)):
            upto = np.cumsum(by_part[inside[w]].sum(0))
            n = int(upto[-1])
            out[w][columns[i]] = (n, [None] * len(at))
            for j, q in enumerate(at if n else []):
                rank = int(np.floor((n - 1) * q + 0.5))
                place = int(np.searchsorted(upto, rank, "right"))
                asked.setdefault((i, place), []).append((w, j, rank - (int(upto[place - 1]) if place else 0)))
    wanted = [np.isin(np.arange(RANGES), [p for c, p in asked if c == i]) for i in range(len(columns))]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(columns)):
                v, place, part = placed(batch, i)
                on = wanted[i][place]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(on.sum(), i, np.int32)), pa.array(place[on].astype(np.int32)),
                    pa.array(part[on].astype(np.int32)), pa.array(v[on])], names=["i", "place", "part", "v"])

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by("v")
        i, place = table.column("i")[0].as_py(), table.column("place")[0].as_py()
        v, part, n = _numbers(table, "v"), _numbers(table, "part", np.int64), _numbers(table, "n", np.int64)
        found = [(w, j, i, v[np.searchsorted(np.cumsum(n * inside[w][part]), r, "right")]) for w, j, r in asked[i, place]]
        return pa.table({c: pa.array([f[k] for f in found], t) for k, (c, t) in enumerate(
            (("w", pa.int32()), ("j", pa.int32()), ("i", pa.int32()), ("v", pa.float64())))})

    few = known.mapInArrow(near, "i int, place int, part int, v double").groupBy("i", "place", "part", "v").agg(F.count("*").alias("n"))
    for r in few.groupBy("i", "place").applyInArrow(pick, "w int, j int, i int, v double").collect():  # a row a quantile
        out[r["w"]][columns[r["i"]]][1][r["j"]] = r["v"]
    return out


def _added(key: str):
    """Sums of whole numbers by key."""

    def add(table: pa.Table) -> pa.Table:
        n = np.sum([np.frombuffer(b.as_py(), np.int64) for b in table.column("counts")], axis=0)
        return pa.table({key: table.column(key).slice(0, 1), "counts": pa.array([n.tobytes()], pa.binary())})

    return add


def about(rows: DataFrame, products: Products, spans: list[Span], lag: int) -> DataFrame:
    """(w, p, kept, n, ...): a row a window and pattern that holds in it; all but securities.

    up, down: rows of a positive and a negative outcome, which tell the sign of the median; xn, xup, xdown: those of the excess.
    """
    other, size = "x" in rows.columns, len(products.a)
    k = 7 if other else 4

    def sums(table: pa.Table) -> pa.Table:
        found, total, n = np.zeros((k + 1, size)), 0.0, 0.0
        for part in _chunks(table):
            y, known = _outcome(part, "y")
            weights = [y, None, *_signs(y, known)]
            if other:
                x, there = _outcome(part, "x")
                weights += _signs(x, known * there)
            found += products.sums(_states(part, products.n), weights)
            total, n = total + y.sum(), n + known.sum()
        counts = np.rint(found[1:]).astype(np.int32)
        at = range(0, size, CHUNK)
        return pa.table({"chunk": pa.array([i // CHUNK for i in at], pa.int32()), "date": pa.array([table.column("date")[0].as_py()] * len(at)),
            "base": pa.array([total / n if n else None] * len(at), pa.float64()),
            "counts": pa.array([np.ascontiguousarray(counts[:, i : i + CHUNK]).tobytes() for i in at], pa.binary()),
            "totals": pa.array([found[0, i : i + CHUNK].tobytes() for i in at], pa.binary())})

    members = [np.isin(np.arange(size), s.patterns) for s in spans]

    def put_together(table: pa.Table) -> pa.Table:
        table = table.sort_by("date")
        first = table.column("chunk")[0].as_py() * CHUNK
        held = np.stack([np.frombuffer(b.as_py(), np.int32) for b in table.column("counts")]).reshape(table.num_rows, k, -1)
        totals = np.stack([np.frombuffer(b.as_py(), np.float64) for b in table.column("totals")])
        day, base, out = _days(table), _numbers(table, "base"), []
        for w, s in enumerate(spans):
            inside = (day >= s.days[0]) & (day < s.days[1])
            counts, total, against = held[inside], totals[inside], base[inside]
            whole = counts.sum(0, dtype=np.int64)
            for i in np.flatnonzero((whole[0] > 0) & members[w][first : first + CHUNK]):
                some = counts[:, 1, i] > 0
                mean = total[some, i] / counts[some, 1, i]
                known = int(some.sum())
                signs = [int(c) for c in whole[2:, i]] + ([] if other else [0, 0, 0])
                out.append((w, first + int(i), int(whole[0, i]), int(whole[1, i]), known, *signs,
                    robust(mean, lag) if known else None, robust(mean - against[some], lag) if known else None))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], _KINDS[c.split()[1]]) for i, c in enumerate(_ABOUT.split(", "))],
            names=[c.split()[0] for c in _ABOUT.split(", ")])

    by_day = rows.drop("security_id").groupBy("date").applyInArrow(sums, "chunk int, date date, base double, counts binary, totals binary")
    return by_day.groupBy("chunk").applyInArrow(put_together, _ABOUT)


_ABOUT = ("w int, p int, kept long, n long, n_dates long, up long, down long, xn long, xup long, xdown long, newey_west_t double, "
    "vs_baseline_nw_t double")
_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def securities(rows: DataFrame, products: Products, spans: list[Span]) -> dict[tuple[int, int], int]:
    """By window and pattern: securities with a known outcome, from a bit a pattern for every security and window."""
    edges, inside = _parts(spans)
    size = max(-(-len(s.patterns) // 64) for s in spans)
    names = [f"b{i}" for i in range(size)]
    mine = [np.array(s.patterns, np.int64) for s in spans]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = _numbers(pa.table({"c": batch.column("security_id").dictionary_encode().indices}), "c", np.float64)
            part = np.searchsorted(edges, _days(batch), "right") - 1
            held = (_states(batch, products.n) * _outcome(batch, "y")[1][:, None]).astype(np.float32)
            new = ~((code[1:] == code[:-1]) | (np.isnan(code[1:]) & np.isnan(code[:-1])))
            begins = np.flatnonzero(np.r_[True, new])
            who, window, marks = [], [], []
            for at, to in zip(begins, np.r_[begins[1:], batch.num_rows]):
                parts, own = {}, part[at:to]
                for i in np.unique(own):
                    parts[i] = products.sums(held[at:to][own == i], [None])[0] > 0
                for w in range(len(spans)):
                    met = [m for i, m in parts.items() if i >= 0 and inside[w][i]]
                    if met:
                        bits = np.zeros(size * 64, np.uint8)
                        bits[: len(mine[w])] = np.logical_or.reduce(met)[mine[w]]
                        who.append(at), window.append(w), marks.append(bits)
            if who:
                words = np.packbits(np.stack(marks), axis=1, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("security_id").take(pa.array(who)), pa.array(window, pa.int32()),
                    *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(size))], names=["security_id", "w", *names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(spans), size * 64), np.int64)
        for batch in batches:
            words = np.stack([_numbers(batch, c, np.int64) for c in names], 1)
            bits, window = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little"), _numbers(batch, "w", np.int64)
            for w in np.unique(window):
                n[w] += bits[window == w].sum(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(spans)), pa.int32()), pa.array([c.tobytes() for c in n], pa.binary())],
            names=["w", "counts"])

    marked = rows.select("security_id", "date", "y", *(c for c in rows.columns if c.startswith("w")))
    marked = marked.mapInArrow(mark, "security_id string, w int, " + ", ".join(f"{c} long" for c in names))
    # A security counts once a window however many runs it has; one without a name doesn't.
    once = marked.filter(F.col("security_id").isNotNull()).groupBy("security_id", "w").agg(*(F.bit_or(c).alias(c) for c in names))
    counted = once.drop("security_id").mapInArrow(count, "w int, counts binary").groupBy("w").applyInArrow(_added("w"), "w int, counts binary")
    found = {r["w"]: np.frombuffer(r["counts"], np.int64) for r in counted.collect()}  # a row a window
    return {(w, int(p)): int(n) for w, c in found.items() for p, n in zip(mine[w], c)}


def middle_pairs(rows: DataFrame, value: str, products: Products, spans: list[Span], asked: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """By window and pattern: the middle of the largest negative and the least positive outcome, for medians that lie between."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.full((2, len(asked)), [[-np.inf], [np.inf]])
        for batch in batches:
            if not batch.num_rows:
                continue
            v, day, held = _numbers(batch, "v"), _days(batch), _states(batch, products.n) > 0
            for i, (w, p) in enumerate(asked):
                on = held[:, products.a[p]] & held[:, products.b[p]] & (day >= spans[w].days[0]) & (day < spans[w].days[1])
                ends[0, i] = max(ends[0, i], v[on & (v < 0)].max(initial=-np.inf))
                ends[1, i] = min(ends[1, i], v[on & (v > 0)].min(initial=np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(asked)), pa.int32()), *map(pa.array, ends)], names=["i", "low", "high"])

    known = rows.filter(F.col("y").isNotNull() & F.col(value).isNotNull()).select("date", F.col(value).alias("v"),
        *(c for c in rows.columns if c.startswith("w")))
    found = known.mapInArrow(near, "i int, low double, high double").groupBy("i").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    return {asked[r["i"]]: r["low"] / 2 + r["high"] / 2 for r in found.collect()}  # a row a pattern asked for
