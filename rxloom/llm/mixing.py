"""Mixing sources to target weights.

A mix is a tree domain - language - source. A leaf's weight is its source's target share times the part of the source's
tokens in that language; weights add up towards the root. The budget is handed down by weight. What a leaf can't take,
because it may repeat its texts only so often, goes to its siblings by weight; what a whole node can't take goes to the
node's siblings, and so on to the root. A leaf fills its budget with seeded epochs: whole passes over its texts and the
prefix of one more pass, in an order drawn from the seed.

Only sums per leaf reach the driver: as many as mix targets times languages. The prefix is cut in three steps: over sums of
CELLS coarse cells of the drawn order, over sums of as many fine cells of the coarse one that holds the cut, and within
that fine cell. So no task sums or sorts more than CELLS rows or a part in CELLS x CELLS of a source.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of the drawn order on each of two levels, as powers of 2.
CELL_BITS = 10


@dataclass
class Node:
    weight: float = 0.0
    capacity: float = 0.0
    budget: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)

    def child(self, name: str) -> Node:
        return self.children.setdefault(name, Node())

    def total(self) -> None:
        if self.children:
            for c in self.children.values():
                c.total()
            self.weight = sum(c.weight for c in self.children.values())
            self.capacity = sum(c.capacity for c in self.children.values())

    def spend(self, budget: float) -> None:
        """Hands the budget down; a shortage stays among siblings as long as they can take it."""
        self.budget = min(budget, self.capacity)
        left, open_ = self.budget, [c for c in self.children.values() if c.capacity > 0]
        given = {id(c): 0.0 for c in open_}
        while open_ and left > 1e-9:
            weight = sum(c.weight for c in open_)
            share = {id(c): left * (c.weight / weight if weight else 1 / len(open_)) for c in open_}
            short = [c for c in open_ if given[id(c)] + share[id(c)] >= c.capacity - 1e-9]
            if not short:
                for c in open_:
                    given[id(c)] += share[id(c)]
                break
            for c in short:
                left -= c.capacity - given[id(c)]
                given[id(c)] = c.capacity
            open_ = [c for c in open_ if c not in short]
        for c in self.children.values():
            c.spend(given.get(id(c), 0.0))


def leaf_budgets(targets: list[tuple[str, str, float, int]], sums: dict[tuple[str, str], int], total: float | str | None = None, domains: dict[str, str] | None = None) -> list[tuple[str, str, str, str, float, int, int]]:
    """(mix, source, language, domain, budget, tokens of one epoch, most repeats) of each leaf.

    sums: tokens by (source, language). total: size of a mix in tokens, by default what its sources hold once;
    `reachable` is the largest size at which no source that has documents falls short of its share. domains: that of each
    source; a source that isn't named forms a domain of its own.
    """
    out = []
    for mix in sorted({t[0] for t in targets}):
        rows = [t for t in targets if t[0] == mix]
        root, leaves = Node(), []
        for _, source, share, repeats in rows:
            langs = {lang: n for (s, lang), n in sums.items() if s == source}
            whole = sum(langs.values())
            for lang, n in sorted(langs.items()):
                domain = (domains or {}).get(source, source)
                leaf = root.child(domain).child(lang).child(source)
                leaf.weight, leaf.capacity = (share * n / whole if whole else 0.0), float(n * max(0, repeats))
                leaves.append((source, lang, domain, leaf, n, max(0, repeats)))
        root.total()
        once = float(sum(n for *_, n, _ in leaves))
        fits = min((leaf.capacity * root.weight / leaf.weight for *_, leaf, _, _ in leaves if leaf.weight > 0), default=0.0)
        root.spend(once if total is None else fits if total == "reachable" else total)
        out += [(mix, source, lang, domain, leaf.budget, n, repeats) for source, lang, domain, leaf, n, repeats in leaves]
    return out


def language(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.rlike("^[a-z]{2}$"), low).otherwise(F.lit("und"))


def mix_choice(sized: DataFrame, targets: DataFrame, seed: int = 17, total: float | str | None = None, domains: dict[str, str] | None = None, cell_bits: int = CELL_BITS) -> DataFrame:
    """(mix_name, source, lang, domain, doc_id, n_tokens, times) of each document used in a mix.

    sized: doc_id, source, lang, n_tokens; read several times, so materialise it before. targets: mix_name, source,
    target_share, max_repeats. Documents without id, text, tokens or source can't count towards a share and are left out; an
    unknown language is `und`. A source without documents leaves its share to its siblings. Empty tables give no rows.
    """
    spark = sized.sparkSession
    docs = sized.where("doc_id IS NOT NULL AND n_tokens > 0 AND source IS NOT NULL").select("doc_id", "source", language(F.col("lang")).alias("lang"), "n_tokens")
    sums = {(r[0], r[1]): int(r[2]) for r in docs.groupBy("source", "lang").agg(F.sum("n_tokens")).collect()}
    wanted = [(r[0], r[1], float(r[2]), int(r[3])) for r in targets.where("mix_name IS NOT NULL AND source IS NOT NULL").select("mix_name", "source", F.coalesce("target_share", F.lit(0.0)), F.coalesce("max_repeats", F.lit(1))).collect()]
    leaves = [(m, s, lang, dom, n, min(int(b // n), r), int(b - n * min(int(b // n), r)) if b < n * r else 0) for m, s, lang, dom, b, n, r in leaf_budgets(wanted, sums, total, domains) if n]
    plan = spark.createDataFrame(leaves, "mix_name string, source string, lang string, domain string, leaf_tokens long, epochs int, prefix long")
    # the plan and the cuts have as many rows as mix targets times languages
    used = docs.join(F.broadcast(plan.where("epochs > 0 OR prefix > 0")), ["source", "lang"]).withColumn("draw", F.xxhash64(F.lit(seed), "mix_name", "epochs", "doc_id"))
    cell = lambda level: F.shiftrightunsigned("draw", 64 - level * cell_bits).bitwiseAND((1 << cell_bits) - 1)
    used = used.withColumn("coarse", cell(1)).withColumn("fine", cell(2))
    leaf = ["mix_name", "source", "lang"]

    def holding(rows: DataFrame, level: str, start: Column, name: str) -> DataFrame:
        """The cell of each leaf that holds the cut, and the tokens before it."""
        before = Window.partitionBy(*leaf).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy(*leaf, level, "prefix", start.alias("start")).agg(F.sum("n_tokens").alias("t")).withColumn("before", F.col("start") + F.coalesce(F.sum("t").over(before), F.lit(0)))
        return sums.where("before <= prefix AND before + t > prefix").select(*leaf, F.col(level).alias(f"cut_{level}"), F.col("before").alias(name))

    first = holding(used.where("prefix > 0"), "coarse", F.lit(0).cast("long"), "so_far_coarse")
    within = used.join(F.broadcast(first), leaf).where("coarse = cut_coarse")
    second = holding(within, "fine", F.col("so_far_coarse"), "so_far")
    marked = used.join(F.broadcast(first), leaf, "left").join(F.broadcast(second), leaf, "left")
    inside = Window.partitionBy(*leaf).orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = F.coalesce((F.col("coarse") == F.col("cut_coarse")) & (F.col("fine") == F.col("cut_fine")), F.lit(False))
    edge = marked.where(at_cut).withColumn("extra", (F.col("so_far") + F.sum("n_tokens").over(inside) <= F.col("prefix")).cast("int"))
    early = (F.col("prefix") > 0) & (F.col("cut_coarse").isNull() | (F.col("coarse") < F.col("cut_coarse")) | ((F.col("coarse") == F.col("cut_coarse")) & (F.col("fine") < F.col("cut_fine"))))
    plain = marked.where(~at_cut).withColumn("extra", early.cast("int"))
    both = plain.unionByName(edge)
    return both.withColumn("times", F.col("epochs") + F.col("extra")).where("times > 0").select("mix_name", "source", "lang", "domain", "doc_id", "n_tokens", "times")


def with_shares(choice: DataFrame, targets: DataFrame) -> DataFrame:
    """The choice with target and reached share of each document's source: one more pass over sums per source."""
    return choice.join(F.broadcast(share_report(choice, targets).select("mix_name", "source", "target_share", "actual_share")), ["mix_name", "source"])


def share_report(choice: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, tokens, texts, actual_share, most_times) of every target."""
    per = choice.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.sum("times").alias("texts"), F.max("times").alias("most_times"))
    all_ = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return targets.select("mix_name", "source", "target_share", "max_repeats").join(per, ["mix_name", "source"], "left").na.fill(0, ["tokens", "texts", "most_times"]).withColumn("actual_share", F.when(all_ > 0, F.round(F.col("tokens") / all_, 6)).otherwise(F.lit(0.0)))
