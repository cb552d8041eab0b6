"""Statistics of all states and pairs of states from rows packed to bits, by products of incidence matrices.

A row's true states are bits of whole numbers. How many rows two states share, and sums of outcomes over them, are products
of the matrix of states with itself, so a row costs the same however many patterns hold in it, and no row is repeated a
pattern. What is shuffled are packed rows by date, a row a pattern and date, and outcomes near the medians.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States that a whole number holds.
WORD = 62
#: Rows whose states are unpacked at once, and rows that are sorted by range of outcome together.
ROWS, SORTED = 1 << 14, 1 << 18
#: Ranges of outcomes, of about as many rows each, in which medians are looked for.
RANGES = 256

Pattern = tuple[str, int, int]


def packed(df: DataFrame, tests: list[Column], y: Column, x: Column | None) -> DataFrame:
    """(security_id, date, y, x, w0, ...): outcomes, and the states that hold as bits."""
    words = []
    for at in range(0, len(tests), WORD):
        word = F.lit(0).cast("long")
        for i, test in enumerate(tests[at : at + WORD]):
            word = word.bitwiseOR(F.when(test, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        words.append(word.alias(f"w{at // WORD}"))
    return df.select("security_id", "date", y.alias("y"), *([] if x is None else [x.alias("x")]), *words)


def _states(table: pa.Table | pa.RecordBatch, n: int) -> np.ndarray:
    """The matrix of rows and states."""
    parts = []
    for at in range(0, n, WORD):
        word = np.ascontiguousarray(_numbers(table, f"w{at // WORD}", np.int64))
        parts.append(np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : min(WORD, n - at)])
    return np.concatenate(parts, 1).astype(np.float64)


def _numbers(table: pa.Table | pa.RecordBatch, name: str, kind: type = np.float64) -> np.ndarray:
    """A column, nulls as NaN."""
    c = table.column(name)
    return np.asarray(c.to_numpy() if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False)).astype(kind, copy=False)


class Products:
    """Sums of weights over the rows in which each pattern holds."""

    def __init__(self, patterns: list[Pattern], n_states: int):
        self.a, self.b = (np.array([p[i] for p in patterns], np.int64) for i in (1, 2))
        self.n = n_states

    def rows(self, held: np.ndarray) -> np.ndarray:
        return held[:, self.a] * held[:, self.b]

    def sums(self, held: np.ndarray, weights: list[np.ndarray | None]) -> np.ndarray:
        if len(self.a) <= self.n:
            rows = self.rows(held)
            return np.stack([rows.sum(0) if w is None else w @ rows for w in weights])
        return np.stack([((held if w is None else held * w[:, None]).T @ held)[self.a, self.b] for w in weights])


def _chunks(table: pa.Table) -> Iterator[pa.Table]:
    for at in range(0, table.num_rows, ROWS):
        yield table.slice(at, ROWS)


def _outcome(table: pa.Table | pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """An outcome with 0 where it isn't known, and where it is."""
    y = _numbers(table, name)
    known = ~np.isnan(y)
    return np.where(known, y, 0.0), known.astype(np.float64)


_DAILY = "p int, date date, kept long, n long, total double, winsor double, up long, xn long, xtotal double, base double"


def daily(rows: DataFrame, products: Products, bounds: tuple[float, float] | None) -> DataFrame:
    """(p, date, ...): counts and sums of a pattern's rows of a date; base: the mean outcome of all rows of the date."""
    other = "x" in rows.columns

    def run(table: pa.Table) -> pa.Table:
        sums, total, n = np.zeros((7, len(products.a))), 0.0, 0.0
        for part in _chunks(table):
            y, known = _outcome(part, "y")
            x, there = _outcome(part, "x") if other else (y, known)
            clip = y if bounds is None else np.clip(y, *bounds) * known
            sums += products.sums(_states(part, products.n), [None, known, y, clip, known * (y > 0), there * known, x * known])
            total, n = total + y.sum(), n + known.sum()
        p = np.flatnonzero(sums[0])
        whole = lambda i: pa.array(np.rint(sums[i][p]).astype(np.int64))
        date = table.column("date").combine_chunks()[0].as_py()
        return pa.table({"p": pa.array(p.astype(np.int32)), "date": pa.array([date] * len(p), pa.date32()), "kept": whole(0), "n": whole(1),
            "total": pa.array(sums[2][p]), "winsor": pa.array(sums[3][p]), "up": whole(4), "xn": whole(5), "xtotal": pa.array(sums[6][p]),
            "base": pa.array([total / n if n else None] * len(p), pa.float64())})

    return rows.drop("security_id").groupBy("date").applyInArrow(run, _DAILY)


def robust(x: np.ndarray, lag: int) -> float | None:
    """The t of a mean with Bartlett weights, as ``research.newey_west`` has it."""
    n, lag = len(x), max(lag, 1)
    d = x - x.mean()
    v, most = d @ d, min(lag, n - 1)
    for k in range(1, most + 1):
        v += 2 * (1 - k / (most + 1)) * (d[k:] @ d[:-k])
    v /= n
    return float(x.mean() / np.sqrt(v / n)) if n >= 3 and v > 1e-18 else None


_ABOUT = ("p int, kept long, n long, n_dates long, mean double, winsor_mean double, positive_ratio double, excess_mean double, "
    "daily_mean double, daily_median double, daily_positive_ratio double, newey_west_t double, vs_baseline_mean double, "
    "vs_baseline_nw_t double, vs_baseline_n long")


def about(days: DataFrame, lag: int) -> DataFrame:
    """A row a pattern from its days: all statistics but medians and securities."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("date")
        kept, n, total, winsor, up, xn, xtotal, base = (_numbers(table, c)
            for c in ("kept", "n", "total", "winsor", "up", "xn", "xtotal", "base"))
        some = n > 0
        day = total[some] / n[some]
        row: list = [table.column("p")[0].as_py(), int(kept.sum()), int(n.sum()), int(some.sum())]
        if some.any():
            diff, all_n = day - base[some], n.sum()
            row += [total.sum() / all_n, winsor.sum() / all_n, up.sum() / all_n, xtotal.sum() / xn.sum() if xn.sum() else None]
            row += [day.mean(), np.median(day), (day > 0).mean(), robust(day, lag), diff.mean(), robust(diff, lag), len(diff)]
        else:
            row += [None] * 10 + [0]
        return pa.table({f.split()[0]: pa.array([v], _KINDS[f.split()[1]]) for f, v in zip(_ABOUT.split(", "), row)})

    return days.groupBy("p").applyInArrow(run, _ABOUT)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def securities(rows: DataFrame, products: Products) -> DataFrame:
    """(p, n_securities): securities with a known outcome in a pattern, from a bit a pattern for every run of a security's rows."""
    size = -(-len(products.a) // 64)
    names = [f"b{i}" for i in range(size)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("security_id").dictionary_encode()
            code = _numbers(pa.table({"c": codes.indices}), "c", np.float64)
            start = np.flatnonzero(np.r_[True, ~((code[1:] == code[:-1]) | (np.isnan(code[1:]) & np.isnan(code[:-1])))])
            held = _states(batch, products.n) * _outcome(batch, "y")[1][:, None]
            bits = np.zeros((len(start), size * 64), np.uint8)
            for i, (at, to) in enumerate(zip(start, np.r_[start[1:], batch.num_rows])):
                bits[i, : len(products.a)] = products.sums(held[at:to], [None])[0] > 0
            words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("security_id").take(pa.array(start)),
                *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(size))], names=["security_id", *names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size * 64, np.int64)
        for batch in batches:
            words = np.stack([_numbers(batch, c, np.int64) for c in names], 1)
            n += np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        p = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(n[p])], names=["p", "n_securities"])

    marked = rows.drop("date", "x").mapInArrow(mark, "security_id string, " + ", ".join(f"{c} long" for c in names))
    # A security counts once however many runs it has; one without a name doesn't.
    once = marked.filter(F.col("security_id").isNotNull()).groupBy("security_id").agg(*(F.bit_or(c).alias(c) for c in names))
    return once.drop("security_id").mapInArrow(count, "p int, n_securities long").groupBy("p").agg(F.sum("n_securities").alias("n_securities"))


def _by_range(batches: Iterator[pa.RecordBatch], value: str, edges: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[tuple]:
    """(range, table) of known rows, ``SORTED`` at a time; only of the wanted ranges."""
    held: list[pa.Table] = []

    def dealt() -> Iterator[tuple]:
        table = pa.concat_tables(held).combine_chunks()
        place = np.searchsorted(edges, _numbers(table, value), "right")
        order = np.argsort(place, kind="stable")
        place, table = place[order], table.take(pa.array(order))
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        for at, to in zip(start, np.r_[start[1:], len(place)]):
            yield int(place[at]), table.slice(at, to - at)

    size = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        v = _numbers(table, value)
        keep = ~np.isnan(v)
        if wanted is not None:
            keep &= wanted[np.searchsorted(edges, v, "right").clip(0, len(wanted) - 1)]
        table = table.filter(pa.array(keep))
        if table.num_rows:
            held.append(table)
            size += table.num_rows
        if size >= SORTED:
            yield from dealt()
            held, size = [], 0
    if held:
        yield from dealt()


def medians(rows: DataFrame, products: Products, value: str) -> dict[int, float]:
    """The exact median of a known outcome of each pattern: counts by range of outcomes first, then the values of the middle's range."""
    words = [c for c in rows.columns if c.startswith("w")]
    known = rows.filter(F.col("y").isNotNull() & F.col(value).isNotNull()).select(F.col(value).alias("v"), *words)
    cuts = [i / RANGES for i in range(1, RANGES)]
    got = known.agg(F.percentile_approx("v", F.array(*map(F.lit, cuts)), F.lit(2000)).alias("q")).first()["q"]
    if got is None:
        return {}
    edges = np.unique(np.array(got, np.float64))
    size = len(products.a)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, np.ndarray] = {}
        for at, table in _by_range(batches, "v", edges):
            for part in _chunks(table):
                n[at] = n.get(at, 0) + products.sums(_states(part, products.n), [None])[0].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array([c.tobytes() for c in n.values()], pa.binary())],
            names=["at", "counts"])

    def add(table: pa.Table) -> pa.Table:
        n = np.zeros(size, np.int64)
        for blob in table.column("counts"):
            n += np.frombuffer(blob.as_py(), np.int64)
        p = np.flatnonzero(n)
        return pa.table({"p": pa.array(p.astype(np.int32)), "at": pa.array([table.column("at")[0].as_py()] * len(p), pa.int32()),
            "c": pa.array(n[p])})

    counts = known.mapInArrow(count, "at int, counts binary").groupBy("at").applyInArrow(add, "p int, at int, c long")
    one = Window.partitionBy("p")
    counts = counts.withColumn("upto", F.sum("c").over(one.orderBy("at"))).withColumn("n", F.sum("c").over(one))
    holds = lambda r: (F.col("upto") > r) & (F.col("upto") - F.col("c") <= r)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    found = counts.filter(holds(low) | holds(high)).select("p", "at", (F.col("upto") - F.col("c")).alias("before"), "n").collect()
    asked: dict[int, list[int]] = {}
    places: dict[int, tuple[int, int]] = {}
    for r in found:  # a row or two a pattern
        asked.setdefault(r["at"], []).append(r["p"])
        places[r["p"]] = (min(r["before"], places.get(r["p"], (r["before"], 0))[0]), r["n"])
    wanted = np.isin(np.arange(len(edges) + 1), list(asked))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, table in _by_range(batches, "v", edges, wanted):
            held, v = _states(table, products.n) > 0, _numbers(table, "v")
            out = []
            for p in asked[at]:
                values, n = np.unique(v[held[:, products.a[p]] & held[:, products.b[p]]], return_counts=True)
                out.append((np.full(len(values), p, np.int32), values, n.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["p", "v", "n"])

    def pick(table: pa.Table) -> pa.Table:
        p = table.column("p")[0].as_py()
        table = table.sort_by("v")
        before, n = places[p]
        upto = before + np.cumsum(_numbers(table, "n", np.int64))
        v = _numbers(table, "v")
        a, b = (v[np.searchsorted(upto, r, "right")] for r in ((n - 1) // 2, n // 2))
        return pa.table({"p": pa.array([p], pa.int32()), "median": pa.array([a / 2 + b / 2])})

    picked = known.mapInArrow(near, "p int, v double, n long").groupBy("p").applyInArrow(pick, "p int, median double")
    return {r["p"]: r["median"] for r in picked.collect()}  # a row a pattern
