"""Common units for quantities recorded in different units and scales.

Each number of a field is an observation of a source history: one sales line, one ingredient of a drug, one ingredient
of an approved product, in the order delivered. Histories are segmented by exact penalised changepoint search on the
logarithm of the number as written: within a segment the number, and so the unit, stays the same. The units written with
the numbers are evidence: they vote for the unit of their segment, and for the amount that the history is about. Where a
segment's level, shifted by a known ratio of units, is at that amount, the shift is a change of unit and is reversed: so
a segment without a unit gets the one that the shift implies, and one whose few written units contradict the rest of the
history gets it too. Every amount follows from the unit of its segment.

Plan: one shuffle of raw rows into ranges of history and order, so that a hot history is spread over tasks; each range is
sorted, parsed and kept. Histories that lie within a range are solved where they lie. The first and the last of a range,
which may go on in the next one, and any too long to be held, are reduced to runs of equal numbers, of which a history
is solved by one task; the runs' results join back to the rows. Changepoints never lie within a run, so nothing depends
on how ranges and runs are cut.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from math import inf, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxloom.functions.arrow import Memo, arrow_schema
from rxloom.functions.quantity import MASS, PERCENT_MICROGRAMS_PER_G, SCALE, quantities, rounded
from rxloom.session import cut

PARSED = "source_table string, row_id long, history long, part int, position_no int, value double, unit_kind string, unit_factor double, amount long"
CONVERTED = "source_table string, row_id long, position_no int, value double, quantity_kind string, amount long, unit_source string, written boolean, segment_no int, level_shift double"
RUN = PARSED + ", seq long"
SOLVED = "history long, position_no int, part int, seq long, segment_no int, level_shift double, kinds array<string>, factors array<double>, bare_kind string, bare_factor double"
#: Rows of a history that a task holds at most; a longer one goes by its runs.
HELD = 100_000
#: Penalty of a further segment in squared log10 units, and how near a shift must come to a known ratio.
PENALTY, NEAR = 0.001, 0.02
#: The history must have this many times the votes of a segment to overrule the units written in it.
OVERRULES = 4
#: log10 of the factors of the known units of each kind.
KNOWN = {
    "mass": sorted({log10(f) for f in MASS.values()}),
    "mass_per_ml": sorted({log10(f / ml) for f in MASS.values() for ml in (1, 5, 10, 100, 1000)}),
    "mass_per_g": sorted({log10(f / g) for f in MASS.values() for g in (1, 100)} | {log10(PERCENT_MICROGRAMS_PER_G)}),
    "activity": sorted({log10(f) for f in SCALE.values()}),
}


def segment(x: list[float], weight: list[int] | None = None, penalty: float = PENALTY) -> list[int]:
    """Starts of the segments that minimise the squared error around segment means plus the penalty of each segment.

    x: levels, each standing for weight observations. Exact: dynamic programming over the last changepoint, with
    candidates pruned that can never be best again (PELT).
    """
    n = len(x)
    if n == 0:
        return []
    s0, s1, s2 = [0.0], [0.0], [0.0]
    for v, w in zip(x, weight if weight is not None else [1] * n):
        v -= x[0]
        s0.append(s0[-1] + w)
        s1.append(s1[-1] + w * v)
        s2.append(s2[-1] + w * v * v)
    best, last, live = [-penalty], [0], [0]
    for t in range(1, n + 1):
        a0, a1, a2 = s0[t], s1[t], s2[t]
        costs, low, at = [], inf, 0
        for j in live:
            d = a1 - s1[j]
            c = best[j] + max(a2 - s2[j] - d * d / (a0 - s0[j]), 0.0)
            costs.append(c)
            if c < low:
                low, at = c, j
        best.append(low + penalty)
        last.append(at)
        live = [j for j, c in zip(live, costs) if c <= low + penalty + 1e-12]
        live.append(t)
    starts, t = [], n
    while t > 0:
        t = last[t]
        starts.append(t)
    return starts[::-1]


def known_factor(kind: str, log_factor: float) -> float | None:
    near = min(KNOWN[kind], key=lambda f: abs(f - log_factor))
    return 10.0**near if abs(near - log_factor) < NEAR else None


def decide(segments: list[tuple[float, dict]]) -> list[tuple[dict[str, float], tuple[str, float] | None]]:
    """For each segment (level, votes of written units): the factor of each kind written in it, and the unit of its bare numbers.

    Units are (kind, factor).
    """
    amounts: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    cell = lambda a: round(a / NEAR)
    for level, votes in segments:
        for (kind, factor), n in votes.items():
            amounts[kind][cell(level + log10(factor))] += n
    about = {}
    for kind, cells in amounts.items():
        full = {c: sum(cells.get(c + i, 0) for i in (-1, 0, 1)) for c in cells}
        c = max(full, key=lambda c: (full[c], cells[c], -c))
        about[kind] = (c * NEAR, full[c])
    by_votes = sorted(about, key=lambda k: (-about[k][1], k))
    out = []
    for level, votes in segments:
        factors, most = {}, {}
        for kind in {k for k, _ in votes}:
            amount, support = about[kind]
            fits = lambda f: abs(level + log10(f) - amount) < 1.5 * NEAR  # noqa: B023, E731
            own, n = max(((f, n) for (k, f), n in votes.items() if k == kind), key=lambda x: (x[1], fits(x[0]), x[0]))
            most[kind] = n
            implied = None if fits(own) or n * OVERRULES > support else known_factor(kind, amount - level)
            factors[kind] = implied or own
        bare = None
        if factors:
            kind = max(factors, key=lambda k: (most[k], k))
            bare = (kind, factors[kind])
        else:
            bare = next(((k, f) for k in by_votes if (f := known_factor(k, about[k][0] - level))), None)
        out.append((factors, bare))
    return out


def solve(runs: tuple) -> list[tuple[int, float, dict[str, float], tuple[str, float] | None]]:
    """For each run (number, observations, ((unit or None, count), ...)) of a history: segment from 1, level shift into it,
    factor of each kind written in the segment, unit of bare numbers. A number of 0 has no level and keeps what is written."""
    at = [i for i, r in enumerate(runs) if r[0] > 0]
    levels = [log10(runs[i][0]) for i in at]
    weights = [runs[i][1] for i in at]
    starts = segment(levels, weights)
    segments = []
    for a, b in zip(starts, [*starts[1:], len(at)]):
        votes: dict = defaultdict(int)
        for i in at[a:b]:
            for u, n in runs[i][2]:
                if u is not None:
                    votes[u] += n
        total = sum(weights[a:b])
        segments.append((sum(x * w for x, w in zip(levels[a:b], weights[a:b])) / total, votes))
    units = decide(segments)
    out = [(1, 0.0, {u[0]: u[1] for u, _ in r[2] if u is not None}, None) for r in runs]
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(at)])):
        shift = segments[k][0] - segments[k - 1][0] if k else 0.0
        for i in at[a:b]:
            out[i] = (k + 1, shift, *units[k])
    return out


def parse_quantities(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Observations of sources given as (name, rows of row_id, history, at, strength, unit), in ranges of history and order.

    Null or number-less strengths give none; a row of a null history has one of its own, a null order is the first. The
    amount is filled where the number has a unit of a known kind. A range is one partition, in order of history, at and
    row_id, and kept in the shared folder; part is its number.
    """
    spark = sources[0][1].sparkSession
    target = arrow_schema(spark, PARSED)

    def work(key: tuple[str | None, str | None]) -> list[tuple]:
        return [
            (float(n), u and u[0], float(u[1]) if u else 0.0, rounded(n * u[1]) if u and u[1] and n * u[1] < 2**62 else None)
            for n, u in quantities(*key)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part = Memo(work, 50_000), TaskContext.get().partitionId()
        for b in batches:
            got = [memo[k] for k in zip(b.column("strength").to_pylist(), b.column("unit").to_pylist())]
            count = np.fromiter(map(len, got), np.int64, len(got))
            row = np.repeat(np.arange(len(got)), count)
            flat = [q for g in got for q in g]
            first = np.repeat(np.cumsum(count) - count, count)
            cols = {c: b.column(c).take(pa.array(row)) for c in ("source_table", "row_id", "history")}
            cols["part"] = pa.array(np.full(len(row), part, np.int32))
            cols["position_no"] = pa.array((np.arange(len(row)) - first + 1).astype(np.int32))
            for j, c in enumerate(("value", "unit_kind", "unit_factor", "amount")):
                cols[c] = pa.array([q[j] for q in flat], target.field(c).type)
            yield pa.RecordBatch.from_pydict(cols, schema=target)

    rows = None
    for name, df in sources:
        own = F.coalesce(F.col("history").cast("long"), F.xxhash64(F.lit("alone"), F.col("row_id").cast("long")))
        one = df.select(F.lit(name).alias("source_table"), F.col("row_id").cast("long").alias("row_id"), F.xxhash64(F.lit(name), own).alias("history"), F.coalesce(F.col("at").cast("long"), F.lit(0)).alias("at"), F.col("strength").cast("string").alias("strength"), F.col("unit").cast("string").alias("unit"))
        rows = one if rows is None else rows.unionByName(one)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("history", "at", "row_id")
    ranges = rows.where("strength RLIKE '[0-9]'").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut(ranges.mapInArrow(run, PARSED))


def whole_histories(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Rows of a range in its order, and whether they are of histories that may go on elsewhere or are too long to hold."""
    held: list[pa.RecordBatch] = []
    first = long = None
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < HELD:
            continue
        t = pa.Table.from_batches(held)
        h = t.column("history").to_numpy()
        first = h[0] if first is None else first
        keep = int(np.searchsorted(h, h[-1]))
        if keep == 0:
            long, keep = h[0], n
        outside = (h[:keep] == first) | (h[:keep] == long) if long is not None else h[:keep] == first
        for mask, border in ((outside, True), (~outside, False)):
            if mask.any():
                yield t.slice(0, keep).filter(pa.array(mask)), border
        held = t.slice(keep).to_batches() if keep < n else []
        n -= keep
    if n:
        t = pa.Table.from_batches(held)
        h = t.column("history").to_numpy()
        first = h[0] if first is None else first
        outside = (h == first) | (h == h[-1]) | (h == long if long is not None else False)
        for mask, border in ((outside, True), (~outside, False)):
            if mask.any():
                yield t.filter(pa.array(mask)), border


def in_runs(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows by history and position, then as before; the starts of the histories and of the runs of equal numbers."""
    h, p = t.column("history").to_numpy(), t.column("position_no").to_numpy()
    by = np.lexsort((np.arange(len(h)), p, h))
    t = t.take(pa.array(by))
    h, p, v = h[by], p[by], t.column("value").to_numpy()
    other = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    starts = np.concatenate(([0], np.flatnonzero(other) + 1))
    return t, starts, np.concatenate(([0], np.flatnonzero(other | (v[1:] != v[:-1])) + 1))


def convert_quantities(observations: DataFrame) -> DataFrame:
    """One row per observation of parse_quantities with its common-unit amount.

    unit_source: `written` (the unit of the segment is the one written with the number), `segment` (the segment's unit,
    where none or a contradicting one is written), `unknown` (another unit) or `none`; the last two have no amount.
    written: the number has a unit of a known kind. Zero and repeated rows count as they are. Ties in the order of a
    history are broken by row_id. An empty table gives no rows.
    """
    spark = observations.sparkSession
    target, border, solved_schema = (arrow_schema(spark, s) for s in (CONVERTED, RUN, SOLVED))

    def unit(kind: str | None, factor: float) -> tuple[str, float] | None:
        return None if kind in (None, "unknown") else (kind, factor)

    def counted(units: list) -> tuple:
        n: dict = defaultdict(int)
        for u in units:
            n[u] += 1
        return tuple(sorted(n.items(), key=str))

    def convert(t: pa.Table, memo: Memo) -> pa.Table:
        t, starts, runs = in_runs(t)
        n = t.num_rows
        value, factor = t.column("value").to_numpy(), t.column("unit_factor").to_numpy()
        kind, amount = np.array(t.column("unit_kind").to_pylist(), object), np.array(t.column("amount").to_pylist(), object)
        ends = np.concatenate((starts[1:], [n]))
        seg, shift = np.ones(n, np.int32), np.zeros(n)
        bare = kind == None  # noqa: E711
        source = np.where(bare, "none", np.where(kind == "unknown", "unknown", "written")).astype(object)
        written = source == "written"
        # a single number with a single unit: its one segment has that unit
        code = np.unique(np.where(bare, "", kind).astype(str), return_inverse=True)[1] + 1000.0 * factor
        plain = (np.minimum.reduceat(value, starts) == np.maximum.reduceat(value, starts)) & (np.minimum.reduceat(code, starts) == np.maximum.reduceat(code, starts))
        for g in np.flatnonzero(~plain):
            a, b = starts[g], ends[g]
            at = runs[np.searchsorted(runs, a) : np.searchsorted(runs, b)].tolist()
            units = [unit(k, f) for k, f in zip(kind[a:b], factor[a:b].tolist())]
            cuts = list(zip(at, [*at[1:], int(b)]))
            found = memo[tuple((float(value[i]), j - i, counted(units[i - a : j - a])) for i, j in cuts)]
            for (i, j), (number, into, factors, other) in zip(cuts, found):
                seg[i:j], shift[i:j] = number, into
                for r in range(i, j):
                    own = units[r - a]
                    if own is not None and factors[own[0]] != own[1]:
                        source[r], amount[r] = "segment", int(round(value[r] * factors[own[0]]))
                    elif own is None and kind[r] is None and other is not None:
                        kind[r], source[r], amount[r] = other[0], "segment", int(round(value[r] * other[1]))
        kind[kind == "unknown"] = None
        cols = [*(t.column(c).combine_chunks() for c in ("source_table", "row_id", "position_no", "value")), pa.array(kind.tolist(), pa.string()), pa.array(amount.tolist(), pa.int64()), pa.array(source.tolist(), pa.string()), pa.array(written), pa.array(seg), pa.array(shift)]
        return pa.Table.from_arrays(cols, schema=target)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(solve, 50_000)
        for t, outside in whole_histories(batches):
            if not outside:
                yield from convert(t, memo).to_batches()

    def at_border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for t, outside in whole_histories(batches):
            if outside:
                t, _, runs = in_runs(t)
                number = np.zeros(t.num_rows, np.int64)
                number[runs[1:]] = 1
                number = seq + np.cumsum(number)
                seq = int(number[-1]) + 1
                yield from pa.Table.from_arrays([*(c.combine_chunks() for c in t.columns), pa.array(number)], schema=border).to_batches()

    def solve_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("history", "position_no", "part", "seq", "value", "n", "units")))

        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), solved_schema)] if out else [pa.array([], f.type) for f in solved_schema], schema=solved_schema)

        for (h, p), some in groupby(rows(), lambda r: r[:2]):
            held = list(some)
            found = solve(tuple((r[4], r[5], tuple((unit(u["unit_kind"], u["unit_factor"]), u["k"]) for u in r[6])) for r in held))
            for r, (number, into, factors, other) in zip(held, found):
                out.append((h, p, r[2], r[3], number, into, list(factors), list(factors.values()), *(other or (None, None))))
            if len(out) > 10_000:
                yield batch()
                out = []
        yield batch()

    key = ["history", "position_no", "part", "seq"]
    outer = observations.mapInArrow(at_border, RUN)
    units = outer.groupBy(*key, "value", "unit_kind", "unit_factor").agg(F.count("*").alias("k"))
    runs = units.groupBy(*key, "value").agg(F.sum("k").alias("n"), F.collect_list(F.struct("unit_kind", "unit_factor", "k")).alias("units"))
    solved = runs.repartition("history", "position_no").sortWithinPartitions(*key).mapInArrow(solve_runs, SOLVED)
    both = outer.join(solved, key)
    known = F.coalesce(F.col("unit_kind") != "unknown", F.lit(False))
    implied = F.when(known, F.try_element_at(F.map_from_arrays("kinds", "factors"), "unit_kind")).when(F.col("unit_kind").isNull(), F.col("bare_factor"))
    kept = known & (implied == F.col("unit_factor"))
    crossing = both.select(
        "source_table", "row_id", "position_no", "value", F.when(known, F.col("unit_kind")).when(F.col("unit_kind").isNull(), F.col("bare_kind")).alias("quantity_kind"),
        F.when(kept, F.col("amount")).when(implied.isNotNull(), F.rint(F.col("value") * implied).try_cast("long")).alias("amount"),
        F.when(kept, "written").when(implied.isNotNull(), "segment").when(F.col("unit_kind").isNull(), "none").otherwise("unknown").alias("unit_source"), known.alias("written"), "segment_no", "level_shift",
    )
    return observations.mapInArrow(inside, CONVERTED).unionByName(crossing)
