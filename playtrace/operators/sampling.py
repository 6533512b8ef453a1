"""Seeded, engine-independent resampling and fold assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.operators.aggregates import value_counts
from playtrace.operators.scan import OrderedScan, position
from playtrace.runtime import materialize


def hashed_number(*parts: Column) -> Column:
    """Non-negative number below 2^60 from the md5 of the parts joined with ``:``."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def kfold(df: DataFrame, k: int, seed: int, keys: list[str], name: str = "fold") -> DataFrame:
    """Fold 0..k-1 of each row from the hash of its keys; needs no shuffle and no row order.

    Fold sizes are equal up to chance, not to within one row.
    """
    return df.withColumn(name, F.pmod(hashed_number(F.lit(seed), *[F.col(c) for c in keys]), F.lit(k)).cast("int"))


def numbered_within(df: DataFrame, label: str, keys: list[str], name: str = "row_in_class") -> DataFrame:
    """0-based number of each row within its class, in order of the keys.

    Classes are few and large, so they are exactly the hot keys the ordered scan cuts into chunks.
    """
    scan = OrderedScan(df, [label], keys).with_running(**{name: position()})
    return scan.result().withColumn(name, F.col(name) - 1)


DRAW_BLOCK = 100_000  # draws that one generated row stands for


class ClassIndex:
    """Rows numbered within their class, and the classes' sizes, each written once; any number of resamples is drawn from them.

    ``df`` is read twice: pass a table that is cheap to read. Rows without a label are in no resample.
    """

    def __init__(self, df: DataFrame, label: str, keys: list[str]):
        self.label, self.columns = label, df.columns
        sizes = value_counts(df, label).filter(F.col(label).isNotNull())
        self.sizes = materialize(sizes.select(label, F.col("n").alias("_size")), "sizes")
        self.rows = materialize(numbered_within(df, label, keys), "numbered")

    def _drawn_numbers(self, mode: str, seeds: list[int]) -> DataFrame:
        """(label, row_in_class, draw, round) of every draw of each round.

        The planner takes draws to be as few as classes and would broadcast them: joins name another way.

        A class is a row, which becomes a row for each block of its draws; blocks are dealt over the cluster before they become
        draws, so neither many classes nor large ones are one task's work or part of the plan.
        """
        label = self.label
        ends = self.sizes.agg(F.min("_size").alias("down"), F.max("_size").alias("over")).first()
        size = ends[mode] or 0
        rounds = F.posexplode(F.array(*[F.lit(s).cast("bigint") for s in seeds])).alias("round", "_seed")
        blocks = self.sizes.filter(F.lit(size > 0)).select(
            label, "_size", F.explode(F.sequence(F.lit(0), F.lit(max(0, size - 1) // DRAW_BLOCK))).alias("_block"))
        # A given number of tasks: the planner would make one of so few and short rows, which stand for many draws.
        session = self.rows.sparkSession
        tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
        blocks = blocks.select("*", rounds).repartition(tasks, label, "_block", "round")
        first = F.col("_block").cast("bigint") * DRAW_BLOCK + 1
        draws = blocks.select(
            label, "_size", "round", "_seed", F.explode(F.sequence(first, F.least(first + DRAW_BLOCK - 1, F.lit(size).cast("bigint")))).alias("draw"))
        number = F.pmod(hashed_number(F.col("_seed"), F.col(label), F.col("draw")), F.col("_size"))
        return draws.select(label, number.alias("row_in_class"), "draw", "round")

    def draw(self, mode: str = "down", seed: int = 42) -> DataFrame:
        """Every class drawn with replacement to the size of the smallest ('down') or largest ('over') class.

        Draw ``i`` of a class takes the row numbered ``md5(seed:class:i) mod class size``. Draws are joined to the numbered
        rows on (class, number), a key that no class can make hot. The result has a ``draw`` column: with the label it
        identifies the drawn row.
        """
        drawn = self._drawn_numbers(mode, [seed]).drop("round")
        return drawn.hint("merge").join(self.rows, [self.label, "row_in_class"], "inner").select(*self.columns, "draw")

    def draw_counts(self, mode: str = "down", seeds: list[int] | None = None, name: str = "draws") -> DataFrame:
        """All rows with ``draws``: how often the resample of each seed draws the row. One table stands for all resamples."""
        seeds = [42] if seeds is None else seeds
        key = [self.label, "row_in_class"]
        counted = self._drawn_numbers(mode, seeds).groupBy(*key, "round").agg(F.count(F.lit(1)).cast("int").alias("n"))
        rounds = counted.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("round", "n"))).alias("_n"))
        each = F.transform(F.sequence(F.lit(0), F.lit(len(seeds) - 1)), lambda i: F.coalesce(F.try_element_at("_n", i), F.lit(0)))
        labelled = self.rows.filter(F.col(self.label).isNotNull())
        return labelled.join(rounds.hint("merge"), key, "left").select(*self.columns, each.alias(name))


def balanced_resample(df: DataFrame, label: str, keys: list[str], mode: str = "down", seed: int = 42) -> DataFrame:
    """One balanced resample of ``df``; see ``ClassIndex.draw``."""
    return ClassIndex(materialize(df, "resample"), label, keys).draw(mode, seed)
