"""Filling containers of fixed capacity with documents of varying length.

Hierarchical multi-length packing: every document goes to the tier of the smallest context size that holds it. The tiers
are packed from the longest down, a document of a shorter tier going first into the gap of a longer tier's container that
it fills best, and into a container of its own tier otherwise. Then, from the shortest tier up, containers that came out
with too much unused space are dissolved and their documents packed into the next longer tier, whose containers hold more
of them and so leave less. Containers are dealt to step groups so that the steps carry even loads. A document is split
only if it exceeds the largest capacity: into full containers and a remainder, which is packed like a document.

Documents and pieces are spread over shards by hash, each packed by one task; a shard holds about SHARD_ROWS of them, so
that the space lost to its last open containers is a small part of it, and no task grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ROWS, STEP = 20_000, 8
#: A container of a shorter tier stays if no more than this part of it is unused.
SLACK = 1 / 128
PLACED = "pack_name string, capacity_tokens long, container_id string, step_id string, position_no int, doc_id long, piece_no int, start_token long, n_tokens long, unused_tokens long"


class Containers:
    """Open containers by their room; the lowest sufficient one is found by a bit mask of the rooms there are."""

    def __init__(self, largest: int):
        self.by_room: list[list[int]] = [[] for _ in range(largest + 1)]
        self.mask = 0
        self.capacity: list[int] = []
        self.room: list[int] = []
        self.items: list[list[int]] = []

    def place(self, item: int, size: int, capacity: int) -> None:
        """Into the container that it fills best, or a new one of the capacity."""
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = self.by_room[room]
            c = stack.pop()
            if not stack:
                self.mask &= ~(1 << room)
            self.items[c].append(item)
        else:
            c, room = len(self.capacity), capacity
            self.capacity.append(capacity)
            self.room.append(0)
            self.items.append([item])
        self.show(c, room - size)

    def show(self, c: int, room: int) -> None:
        self.room[c] = room
        self.by_room[room].append(c)
        self.mask |= 1 << room

    def dissolve(self, chosen: list[int]) -> list[int]:
        """The items of the chosen containers, which are no more."""
        out = []
        for c in chosen:
            out += self.items[c]
            stack = self.by_room[self.room[c]]
            stack.remove(c)
            if not stack:
                self.mask &= ~(1 << self.room[c])
            self.items[c] = []
        return out


def pack_tiers(sizes: np.ndarray, capacities: Sequence[int], slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, capacity of each container); sizes in falling order, none above the largest capacity."""
    caps = sorted(capacities)
    open_ = Containers(caps[-1])
    size = sizes.tolist()
    for i, t in enumerate(np.searchsorted(caps, sizes).tolist()):
        open_.place(i, size[i], caps[t])
    for cap, longer in zip(caps, caps[1:]):
        poor = [c for c, full in enumerate(open_.capacity) if full == cap and open_.items[c] and open_.room[c] > slack * cap]
        for i in sorted(open_.dissolve(poor[::-1])):
            open_.place(i, size[i], longer)
    where, capacity = np.empty(len(size), np.int64), []
    for c, items in enumerate(open_.items):
        if items:
            where[items] = len(capacity)
            capacity.append(open_.capacity[c])
    return where, np.array(capacity, np.int64)


def even_steps(load: np.ndarray, capacity: np.ndarray, step: int = STEP) -> np.ndarray:
    """Step group of each container: the fullest are dealt forth and back over the groups of their capacity."""
    out = np.zeros(len(load), np.int64)
    first = 0
    for c in np.unique(capacity):
        at = np.flatnonzero(capacity == c)
        groups = -(-len(at) // step)
        order = at[np.argsort(-load[at], kind="stable")]
        k = np.arange(len(order))
        lap, pos = k // groups, k % groups
        out[order] = first + np.where(lap % 2 == 0, pos, groups - 1 - pos)
        first += groups
    return out


def pack_documents(sized: DataFrame, packs: list[tuple[str, int]], mixed: bool = True, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Placement of every document (doc_id unique, n_tokens): one row per piece, with the unused space of its container.

    mixed: one packing over the tiers of all capacities. Otherwise one packing per capacity, all documents in containers of
    it alone. Rows without doc_id or size have nothing to place and are left out; a size of 0 takes a position but no space.
    Extra columns are ignored. sized is read twice, so materialise it before. An empty table gives no rows.
    """
    packs = sorted(packs, key=lambda p: p[1])
    names = {c: n for n, c in packs}
    caps = [c for _, c in packs]
    goals = [("mixed", caps[-1])] if mixed else packs
    known = sized.where(F.col("n_tokens").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("size"))
    pieces = lambda c: F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(c))).cast("long")
    counts = known.agg(*[F.coalesce(F.sum(pieces(c)), F.lit(0)) for _, c in goals]).first()
    goal = F.array(*[F.struct(F.lit(n).alias("goal"), F.lit(c).cast("long").alias("cap"), F.lit(max(1, -(-k // shard_rows))).alias("shards")) for (n, c), k in zip(goals, counts)])
    items = known.select("doc_id", "size", F.explode(goal).alias("g")).select("doc_id", "size", "g.*")
    cut_up = items.withColumn("full", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("cap"))).cast("long") - 1)))
    rest = cut_up.select("goal", "cap", "doc_id", F.least(F.col("cap"), F.col("size") - F.col("full") * F.col("cap")).alias("size"), "full", F.pmod(F.xxhash64("doc_id", "full"), F.col("shards")).alias("shard"))
    columns = [f.split()[0] for f in PLACED.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cap, shard = int(pdf["cap"].iloc[0]), int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
        sizes = pdf["size"].to_numpy()
        where, capacity = pack_tiers(sizes, caps if mixed else [cap])
        load = np.bincount(where, weights=sizes, minlength=len(capacity)).astype(np.int64)
        step = even_steps(load, capacity)
        by = np.argsort(where, kind="stable")
        begins = np.flatnonzero(np.r_[True, where[by][1:] != where[by][:-1]])
        position = np.empty(len(by), np.int64)
        position[by] = np.arange(len(by)) - np.repeat(begins, np.diff(np.r_[begins, len(by)])) + 1
        held = capacity[where]
        out = pd.DataFrame(
            {
                "pack_name": [names[c] for c in held.tolist()], "capacity_tokens": held, "container_id": [f"s{shard}-{c}" for c in where.tolist()], "step_id": [f"s{shard}-{s}" for s in step[where].tolist()],
                "position_no": position, "doc_id": pdf["doc_id"], "piece_no": pdf["full"] + 1, "start_token": pdf["full"] * cap, "n_tokens": sizes, "unused_tokens": (capacity - load)[where],
            }
        )
        return out[columns]

    return rest.groupBy("goal", "cap", "shard").applyInPandas(run, PLACED)


def packing_report(placed: DataFrame) -> DataFrame:
    """Containers, tokens and unused space of each capacity."""
    one = placed.groupBy("pack_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    return one.groupBy("pack_name", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.sum(F.col("capacity_tokens") - F.col("t")).alias("unused_tokens"), F.sum("n").alias("pieces")
    ).withColumn("unused_share", F.round(F.col("unused_tokens") / (F.col("tokens") + F.col("unused_tokens")), 6))
