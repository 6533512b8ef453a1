"""Running computations along an order inside each key, safe when one key holds most of the rows.

Two ways, chosen by the measured size of the largest key:

* every key fits a task: an ordinary window partitioned by the key;
* some key does not: the rows are range-partitioned by (key, order) into chunks, each chunk runs its own
  window, and what earlier chunks of the same key contribute is added from a carry table. A chunk border
  can cut one key only, so the carry table has fewer rows than there are chunks. It is broadcast if its files are small.

Both give the same rows; no row is dropped, sampled or capped.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtrace.runtime import group_rows, materialize, small

CHUNK = "_chunk"
TIE = "_tie"


@dataclass(frozen=True)
class Running:
    """One running measure: its kind, the value it reads and whether the current row counts."""

    kind: str
    value: Column
    before: bool = False


def total(value: Column, before: bool = False) -> Running:
    """Running sum; null until the first non-null value."""
    return Running("total", value, before)


def highest(value: Column, before: bool = False) -> Running:
    return Running("highest", value, before)


def latest(value: Column, before: bool = False) -> Running:
    """Last non-null value so far (forward fill)."""
    return Running("latest", value, before)


def mean(value: Column, before: bool = False) -> Running:
    return Running("mean", value, before)


def deviation(value: Column, before: bool = False) -> Running:
    """Sample standard deviation so far; null below two values."""
    return Running("deviation", value, before)


def position() -> Running:
    """1-based place of the row inside its key."""
    return Running("total", F.lit(1).cast("bigint"))


def previous(value: Column) -> Running:
    """Value of the row before, kept even when null; null on the first row. Unwrapped by ``with_running``."""
    return Running("previous", value, True)


# Per kind: the named parts a chunk keeps, as aggregates that also work as running windows.
_PARTS = {
    "total": {"s": F.sum},
    "highest": {"m": F.max},
    "mean": {"n": F.count, "s": lambda c: F.sum(c.cast("double"))},
    "deviation": {"n": F.count, "a": F.avg, "q": F.var_pop},
    "latest": {"v": None},
    "previous": {"v": None},
}


def _carried(kind: str, name: str, w) -> dict[str, Column]:
    """Parts of all earlier chunks, folded over the per-chunk parts ``name_*``."""
    part = lambda p: F.col(f"{name}_{p}")
    if kind == "total":
        return {"s": F.sum(part("s")).over(w)}
    if kind == "highest":
        return {"m": F.max(part("m")).over(w)}
    if kind in ("latest", "previous"):
        return {"v": F.last(part("v"), ignorenulls=True).over(w)}
    if kind == "mean":
        return {"n": F.sum(part("n")).over(w), "s": F.sum(part("s")).over(w)}
    # Shifted by ``base``, the mean of the key's first chunk that has one, so that no two large sums are subtracted.
    off = part("a") - part("base")
    n, first = F.sum(part("n")).over(w), F.sum(part("n") * off).over(w)
    square = F.sum(part("n") * (part("q") + off * off)).over(w) - F.try_divide(first * first, n)
    return {"n": n, "a": F.max(part("base")).over(w) + F.try_divide(first, n), "q": F.greatest(F.try_divide(square, n), F.lit(0.0))}


def _merged(kind: str, here: dict[str, Column], carry: dict[str, Column]) -> Column:
    """The measure over the current chunk's rows plus the carried ones."""
    if kind == "total":
        return F.coalesce(here["s"] + carry["s"], here["s"], carry["s"])
    if kind == "highest":
        return F.greatest(here["m"], carry["m"])
    if kind == "latest":
        return F.coalesce(here["v"], carry["v"])
    if kind == "previous":
        return F.coalesce(here["v"], carry["v"])["x"]
    zero = lambda c: F.coalesce(c, F.lit(0))
    if kind == "mean":
        return F.try_divide(zero(here["s"]) + zero(carry["s"]), zero(here["n"]) + zero(carry["n"]))
    n1, n2 = zero(here["n"]).cast("double"), zero(carry["n"]).cast("double")
    gap = zero(here["a"]) - zero(carry["a"])
    n = n1 + n2
    between = gap * gap * F.coalesce(F.try_divide(n1 * n2, n), F.lit(0.0))
    square = n1 * zero(here["q"]) + n2 * zero(carry["q"]) + between
    return F.when(n > 1, F.sqrt(F.try_divide(square, n - 1)))


def _native(run: Running, w) -> Column:
    if run.kind == "total":
        return F.sum(run.value).over(w)
    if run.kind == "highest":
        return F.max(run.value).over(w)
    if run.kind == "latest":
        return F.last(run.value, ignorenulls=True).over(w)
    if run.kind == "mean":
        return F.avg(run.value).over(w)
    return F.stddev_samp(run.value).over(w)


@dataclass(frozen=True)
class KeySizes:
    """Rows of the largest key and of all keys."""

    largest: int
    rows: int


def key_sizes(df: DataFrame, key: list[str]) -> KeySizes:
    sizes = df.groupBy(*key).count().agg(F.max("count").alias("largest"), F.sum("count").alias("rows")).first()
    return KeySizes(sizes["largest"] or 0, sizes["rows"] or 0)


class OrderedScan:
    """Rows of ``df`` laid out for running measures over ``order`` inside ``key``.

    ``order`` must name a total order within the key if the result is to be deterministic. Unless ``sizes``
    (an upper bound is enough) is given, ``df`` is read twice, first to measure its keys: pass a table that is
    cheap to read, parquet or a materialised frame.
    """

    def __init__(
        self,
        df: DataFrame,
        key: list[str],
        order: list[str],
        descending: bool = False,
        sizes: KeySizes | None = None,
    ):
        self.key = list(key)
        spark = df.sparkSession
        self.places = list(order)
        self.descending = descending
        self.order = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
        sizes = sizes or key_sizes(df, self.key)
        limit = group_rows(spark)
        self.chunked = sizes.largest > limit
        if self.chunked:
            chunks = max(2, ceil(2 * sizes.rows / limit))
            if key_sizes(df, self.key + self.places).largest > limit:
                # Too many rows share one place for a single chunk: number them, so a border can cut them.
                df = materialize(df.withColumn(TIE, F.monotonically_increasing_id()), "numbered")
                self.places.append(TIE)
                self.order.append(F.col(TIE).desc() if descending else F.col(TIE).asc())
            laid = df.repartitionByRange(chunks, *[F.col(c) for c in self.key], *self.order)
            # The partition number is only stable once written down.
            df = materialize(laid.withColumn(CHUNK, F.spark_partition_id()), "chunks")
        self.df, self.staged = df, False

    def with_running(self, **measures: Running) -> "OrderedScan":
        """Add one column per measure; later calls may read the columns of earlier ones."""
        if self.chunked:
            if self.staged:
                # A further stage reads the one before twice, so that one is written down.
                self.df = materialize(self.df, "chunks")
            self.df, self.staged = self._across_chunks(measures), True
            return self
        spec = Window.partitionBy(*self.key).orderBy(*self.order)
        columns = {}
        for name, run in measures.items():
            if run.kind == "previous":
                columns[name] = F.lag(run.value, 1).over(spec)
            else:
                frame = spec.rowsBetween(Window.unboundedPreceding, -1 if run.before else Window.currentRow)
                columns[name] = _native(run, frame)
        self.df = self.df.withColumns(columns)
        return self

    def _across_chunks(self, measures: dict[str, Running]) -> DataFrame:
        df, group = self.df, self.key + [CHUNK]
        spec = Window.partitionBy(*group).orderBy(*self.order)
        # Evaluate the inputs once, under plain names, so aggregates and windows read columns.
        inputs = df.withColumns({f"_in_{n}": r.value for n, r in measures.items()})

        # The last row of a chunk, without sorting it: the row with the extreme order key.
        place = F.struct(*self.places)
        at_end = F.min_by if self.descending else F.max_by

        local, parts = {}, []
        for name, run in measures.items():
            frame = spec.rowsBetween(Window.unboundedPreceding, -1 if run.before else Window.currentRow)
            value = F.col(f"_in_{name}")
            if run.kind == "previous":
                value = F.struct(value.alias("x"))
            for part, build in _PARTS[run.kind].items():
                if build is None:
                    local[f"_l_{name}_{part}"] = F.last(value, ignorenulls=True).over(frame)
                    parts.append(at_end(value, F.when(value.isNotNull(), place)).alias(f"{name}_{part}"))
                else:
                    local[f"_l_{name}_{part}"] = build(value).over(frame)
                    parts.append(build(value).alias(f"{name}_{part}"))

        over_chunks = Window.partitionBy(*self.key).orderBy(CHUNK)
        so_far = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
        carry = {}
        for name, run in measures.items():
            for part, column in _carried(run.kind, name, so_far).items():
                carry[f"_c_{name}_{part}"] = column
        whole_key = over_chunks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        bases = {f"{n}_base": F.first(f"{n}_a", ignorenulls=True).over(whole_key) for n, r in measures.items() if r.kind == "deviation"}
        folded = inputs.groupBy(*group).agg(*parts)
        carried = (
            (folded.withColumns(bases) if bases else folded)
            .withColumns({**carry, "_nth": F.row_number().over(over_chunks)})
            .filter("_nth > 1")
            .select(*[F.col(k).alias(f"_k_{k}") for k in group], *carry)
        )
        match = None
        for k in group:
            same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
            match = same if match is None else match & same
        # A row a chunk that continues a key: sent whole only if what was written is small.
        joined = inputs.withColumns(local).join(small(materialize(carried, "carry")), match, "left")
        merged = {
            name: _merged(
                run.kind,
                {p: F.col(f"_l_{name}_{p}") for p in _PARTS[run.kind]},
                {p: F.col(f"_c_{name}_{p}") for p in _PARTS[run.kind]},
            )
            for name, run in measures.items()
        }
        kept = [c for c in df.columns if c not in merged]
        return joined.select(*kept, *[c.alias(n) for n, c in merged.items()])

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK, TIE)
