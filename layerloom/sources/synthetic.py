"""Synthetic raw tables: repeatable rows that keep all declared keys, relationships and null rates.

Tables are ranges of row numbers; every value is an expression over the row number and a named stream, so rows don't
depend on how they are partitioned, and nothing is generated on the driver. Foreign keys draw an index into the distinct
keys of their parent, which is numbered densely, and are joined on it; unique values are permutations of their domain.
"""

from __future__ import annotations

import math
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerloom.errors import StageError
from layerloom.functions.expressions import name
from layerloom.plans.resolved import Link, ResolvedPlan
from layerloom.sources.counts import key_units, row_counts, units, without_replacement
from layerloom.sources.domains import VAST, possible
from layerloom.sources.random import below, permuted, permuted_product, stream, uniform
from layerloom.sources.values import capacity, distinct, drawn, possible_at, templated
from layerloom.spec import model as m
from layerloom.types import SPARK_TYPES

ROW = "_row"
#: Rows that are numbered in one task when keys with gaps are numbered densely.
SPAN = 1_000_000
#: Rows that one task makes, and tasks of a table up to which that holds; beyond, each makes more.
TASK_ROWS, TASKS = 125_000, 20_000


def _rows(spark: SparkSession, n: int) -> DataFrame:
    tasks = -(-n // TASK_ROWS)
    return spark.range(0, n, 1, max(1, min(tasks, TASKS + n // (TASK_ROWS * 100)))).select(F.col("id").alias(ROW))


def _numbered(universe: DataFrame, at: str) -> DataFrame:
    """`_index`: 0, 1, ... in the order of `at`. Spans of rows are counted first, so no task sorts more than one."""
    spans = universe.withColumn("_span", F.floor(F.col(at) / SPAN))
    counts = spans.groupBy("_span").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # one row for SPAN rows
    offsets = counts.select("_span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_span").orderBy(at)) - 1
    ranked = spans.withColumn("_rank", rank).join(offsets, "_span")
    return ranked.withColumn("_index", (F.col("_before") + F.col("_rank")).cast("bigint")).drop("_span", "_rank", "_before")


class _Builder:
    def __init__(self, spark: SparkSession, plan: ResolvedPlan, seed: int):
        self.plan, self.seed = plan, seed
        self.counts = row_counts(plan, seed)
        self.frames = {t: _rows(spark, n) for t, n in self.counts.items()}
        self.universes: dict[tuple[str, tuple[str, ...]], tuple[DataFrame | None, int]] = {}

    def key(self, *parts: str) -> int:
        return stream(self.plan.scenario.scenario_id, self.seed, "/".join(parts))

    def universe(self, link: Link) -> tuple[DataFrame, int]:
        """The parent's distinct whole keys with `_index`, and how many there are."""
        known = (link.parent, link.parent_columns)
        if known not in self.universes:
            table, columns = self.plan.raw[link.parent], list(link.parent_columns)
            frame = self.frames[link.parent].select(ROW, *map(name, columns))
            whole = not any(c.nullable for c in table.columns if c.name in columns)
            if whole and (set(columns) == set(table.primary_key) or any(c.unique for c in table.columns if c.name in columns)):
                found, n = frame.withColumnRenamed(ROW, "_index"), self.counts[link.parent]
            else:
                found = frame.dropna(subset=columns).groupBy(*map(name, columns)).agg(F.min(ROW).alias(ROW))
                found = _numbered(found, ROW).drop(ROW)
                n = found.count()
            self.universes[known] = (found, n)
        return self.universes[known]

    def masked(self, value: Column, table: m.RawTable, column: m.RawColumn, stream_name: str) -> Column:
        if not column.nullable or column.null_probability <= 0 or column.name in table.primary_key:
            return value
        return F.when(uniform(self.key(table.name, stream_name, "null"), F.col(ROW)) >= column.null_probability, value)

    def add_foreign(self, link: Link, index: Column, exact: bool = False) -> None:
        """Joins the parent's key with each row's index; one null draw for the whole key."""
        table = self.plan.raw[link.child]
        universe, n = self.universe(link)
        own = next(c for c in table.columns if c.name == link.child_columns[0])
        label = "+".join(link.child_columns)
        wanted = index if exact else self.masked(index, table, own, label)
        keyed = universe.select(F.col("_index").alias("_parent"), *[name(p).alias(c) for c, p in zip(link.child_columns, link.parent_columns, strict=True)])
        nobody = -1 - F.col(ROW)  # a null key would meet all others in one partition; these meet none
        rows = self.frames[link.child].withColumn("_wanted", F.coalesce(wanted, nobody) if n else nobody)
        self.frames[link.child] = rows.join(keyed, F.col("_wanted") == F.col("_parent"), "left").drop("_wanted", "_parent")

    def add(self, table: m.RawTable, unit: tuple[str, ...], key_index: dict[tuple[str, ...], Column]) -> None:
        row, n = F.col(ROW), self.counts[table.name]
        link = next((k for k in self.plan.links if k.child == table.name and k.child_columns == unit), None)
        label = "+".join(unit)
        if link is not None:
            size = self.universe(link)[1]
            if unit in key_index:
                index = key_index[unit]
            elif without_replacement(table, link):
                index = permuted(row, size, self.key(table.name, label))
                index = F.when(row < size, index)
            else:
                index = below(max(1, size), self.key(table.name, label), row)
            self.add_foreign(link, index, exact=unit in key_index)
            return
        column = next(c for c in table.columns if c.name == unit[0])
        g = column.generator
        if unit in key_index:
            value = possible_at(g, key_index[unit])
        elif isinstance(g, m.Template):
            value = templated(g, {c.name: c.type for c in table.columns})
        elif column.unique or table.primary_key == (column.name,):
            value = distinct(g, row, n, self.key(table.name, label))
        else:
            value = drawn(g, row, self.key(table.name, label))
        value = self.masked(value.cast(SPARK_TYPES[column.type]), table, column, label)
        self.frames[table.name] = self.frames[table.name].withColumn(column.name, value)

    def composite(self, table: m.RawTable) -> dict[tuple[str, ...], Column]:
        """Indexes for the units of a key of several: a permutation of their whole product, taken apart again or, if vast, made in parts."""
        key = key_units(table, self.plan.links)
        if len(key) < 2 or any(isinstance(c.generator, m.FormattedId) for c in table.columns if (c.name,) in key):
            return {}
        sizes: list[int] = []
        for unit in key:
            link = next((k for k in self.plan.links if k.child == table.name and k.child_columns == unit), None)
            g = next(c.generator for c in table.columns if c.name == unit[0])
            size = self.universe(link)[1] if link else capacity(g)
            if not size:
                return {}
            sizes.append(size if link else min(size, possible(g) or VAST, VAST))
        room, n = math.prod(sizes), self.counts[table.name]
        if room < n:
            raise StageError("generate", f"{table.name}: {room} keys for {n} rows")
        if room > VAST:  # more than can be counted
            places = permuted_product(F.col(ROW), sizes, self.key(table.name, "key"))
            return {unit: places[k] for k, unit in enumerate(key)}
        place = permuted(F.col(ROW), room, self.key(table.name, "key"))
        out, step = {}, 1
        for unit, size in zip(key, sizes, strict=True):
            out[unit] = F.pmod(F.call_function("div", place, F.lit(step).cast("bigint")), F.lit(size).cast("bigint"))
            step *= size
        return out

    def order(self) -> list[tuple[str, tuple[str, ...]]]:
        """All units of all tables, each after those it needs."""
        graph: dict[tuple[str, tuple[str, ...]], set] = {}
        home = {(t.name, c): u for t in self.plan.raw.values() for u in units(t, self.plan.links) for c in u}
        for t in self.plan.raw.values():
            key = key_units(t, self.plan.links)
            for u in units(t, self.plan.links):
                needs = graph.setdefault((t.name, u), set())
                for other in key if u in key and len(key) > 1 else [u]:
                    for link in self.plan.links:
                        if link.child == t.name and link.child_columns == other:
                            needs |= {(link.parent, home[link.parent, p]) for p in link.parent_columns}
                g = next(c.generator for c in t.columns if c.name == u[0])
                if isinstance(g, m.Template):
                    needs |= {(t.name, home[t.name, p]) for p in g.parts}
        return list(TopologicalSorter(graph).static_order())

    def build(self) -> dict[str, DataFrame]:
        composite: dict[str, dict] = {}
        for table_name, unit in self.order():
            table = self.plan.raw[table_name]
            if unit in key_units(table, self.plan.links) and table_name not in composite:
                composite[table_name] = self.composite(table)
            self.add(table, unit, composite.get(table_name, {}))
        return {t.name: self.frames[t.name].select(*[name(c.name) for c in t.columns]) for t in self.plan.raw.values()}


def synthesise(spark: SparkSession, plan: ResolvedPlan, seed: int) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The raw tables of a plan and their row counts; equal plans and seeds give equal rows."""
    builder = _Builder(spark, plan, seed)
    return builder.build(), builder.counts
