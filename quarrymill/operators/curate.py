"""Selecting, ranking, capping and sampling rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BUCKETS = 64


def all_of(predicates: dict[str, Column]) -> Column:
    """Conjunction; null counts as false."""
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in predicates.values()], F.lit(True))


def filtered(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    return df.where(all_of(predicates))


def reject_counts(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """One row: n_rows, n_kept and for each predicate how many rows fail it, in one pass."""
    fails = [F.count_if(~F.coalesce(p, F.lit(False))).alias(f"rejected_{name}") for name, p in predicates.items()]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(all_of(predicates)).alias("n_kept"), *fails)


def large_groups(df: DataFrame, key: Sequence[str], least: int) -> DataFrame:
    """Rows of groups of at least least rows. Small keys are anti-joined, so hot groups are not moved to one task."""
    named = {k: f"__small_{i}" for i, k in enumerate(key)}
    small = df.groupBy(*key).count().where(F.col("count") < least).select(*[F.col(k).alias(n) for k, n in named.items()])
    return df.join(small, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()]), "left_anti")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in this order, which must be total."""
    return top_n(df, key, order, 1)


def top_n(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark cuts groups to n rows before it moves them."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def dominant(items: Column, share: float = 0.5) -> Column:
    """Names of array<struct<name,size>> in order of size, largest first, until their share exceeds share.

    The one that crosses is included; equal sizes keep their order. Empty arrays and sums of zero give none.
    """
    total = F.aggregate(items, F.lit(0).cast("double"), lambda a, x: a + x["size"])
    ranked = F.array_sort(F.transform(items, lambda x, i: F.struct((-x["size"]).alias("k"), i.alias("i"), x["name"].alias("name"))))
    start = F.struct(F.lit(0).cast("double").alias("sum"), F.array().cast("array<string>").alias("names"))

    def take(acc: Column, x: Column) -> Column:
        more = acc["sum"] <= share
        return F.struct(F.when(more, acc["sum"] - x["k"] / total).otherwise(acc["sum"]).alias("sum"), F.when(more, F.concat(acc["names"], F.array(x["name"]))).otherwise(acc["names"]).alias("names"))

    return F.when(total > 0, F.aggregate(ranked, start, take, lambda a: a["names"])).otherwise(F.array().cast("array<string>"))


def seeded(seed: int, key: Column) -> Column:
    """A random order that depends on seed and key alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def capped_sample(df: DataFrame, stratum: Sequence[str], key: str, cap: Column | int, seed: int) -> DataFrame:
    """Up to cap random rows of each stratum, the same in every run. key identifies a row.

    A stratum is first cut to cap in each of BUCKETS parts, so that no task sorts a whole one.
    """
    order = [seeded(seed, F.col(key)), F.col(key)]
    for part in ([F.pmod(F.xxhash64(key), F.lit(BUCKETS))], []):
        rank = F.row_number().over(Window.partitionBy(*stratum, *part).orderBy(*order))
        df = df.withColumn("__rank", rank).where(F.col("__rank") <= cap).drop("__rank")
    return df


def priority_cap(target: int, language: Column, languages: int, priority: Sequence[str]) -> Column:
    """Half the target is shared by all languages, the other half by those of priority."""
    base = target // languages // 2
    return F.when(language.isin(list(priority)), base + target // len(priority) // 2).otherwise(base)


def quota_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n random rows, in proportion to strata; what rounding down leaves goes to the largest remainders.

    The windows run over one row per stratum. A table of n rows or fewer comes back whole.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("rows"))
    every = Window.partitionBy(F.lit(1))
    exact = F.least(F.lit(float(n)), F.sum("rows").over(every)) * F.col("rows") / F.sum("rows").over(every)
    sizes = sizes.withColumn("exact", exact).withColumn("base", F.floor("exact"))
    left = F.least(F.lit(float(n)), F.sum("rows").over(every)) - F.sum("base").over(every)
    rank = F.row_number().over(every.orderBy((F.col("base") - F.col("exact")), F.col(stratum)))
    quota = sizes.select(F.col(stratum).alias("__s"), (F.col("base") + F.when(rank <= left, 1).otherwise(0)).alias("__quota"))
    joined = df.join(quota, F.col(stratum).eqNullSafe(F.col("__s")))
    return capped_sample(joined, [stratum], key, F.col("__quota"), seed).drop("__s", "__quota")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(seeded(seed, F.col(key)), F.col(key))


def split_by_ids(df: DataFrame, id_col: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is in ids, the others). ids: one column."""
    named = ids.select(F.col(ids.columns[0]).alias("__split")).distinct()
    keyed = df.withColumn("__id", id_col)
    match = F.col("__id") == F.col("__split")
    return keyed.join(named, match, "left_semi").drop("__id"), keyed.join(named, match, "left_anti").drop("__id")


def by_version(df: DataFrame, versions: Sequence[str] = ("minimal", "medium", "full")) -> DataFrame:
    """Each row once for each version."""
    return df.withColumn("version", F.explode(F.array(*[F.lit(v) for v in versions])))


def unpivot_versions(df: DataFrame, columns: dict[str, str], value: str, failed: Column) -> DataFrame:
    """A row for each version's column; rows that failed become one row with null version and value."""
    each = F.array(*[F.struct(F.lit(v).alias("version"), F.col(c).alias(value)) for v, c in columns.items()])
    none = F.array(F.struct(F.lit(None).cast("string").alias("version"), F.lit(None).cast(df.schema[next(iter(columns.values()))].dataType).alias(value)))
    rows = df.withColumn("__v", F.explode(F.when(failed, none).otherwise(each)))
    return rows.select(*[c for c in df.columns if c not in columns.values()], "__v.version", f"__v.{value}")


def exploded_at_least(df: DataFrame, items: str, least: int, names: str = "all_names") -> DataFrame:
    """A row for each element of array<struct<name,size>> of size least or more: name, size, and all names of its row."""
    rows = df.withColumn(names, F.transform(items, lambda x: x["name"])).withColumn("__x", F.explode(items))
    return rows.where(F.col("__x")["size"] >= least).select(*[c for c in df.columns if c != items], names, F.col("__x")["name"].alias("name"), F.col("__x")["size"].alias("size"))


def without_positions(df: DataFrame, position: str, positions: list[int]) -> DataFrame:
    return df.where(~F.col(position).isin(positions))


def merged_versions(df: DataFrame, position: str, version: str, merged: dict[int, list[int]], dropped: list[int]) -> DataFrame:
    """Rows that are not dropped, with possible_version: the versions of the positions merged into theirs, else their own.

    merged is small and given by hand; versions come by a join on position, dropped rows' among them.
    """
    of = F.create_map(*[x for k, v in merged.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if merged else F.create_map().cast("map<int,array<int>>")
    kept = without_positions(df, position, dropped).withColumn("__from", F.coalesce(F.try_element_at(of, F.col(position).cast("int")), F.array(F.col(position).cast("int"))))
    wanted = sorted({x for v in merged.values() for x in v})
    others = df.where(F.col(position).isin(wanted)).select(F.col(position).cast("int").alias("p"), F.col(version).alias("v"))
    few = others.agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("__of"))  # one row, of positions given by hand
    return kept.crossJoin(F.broadcast(few)).withColumn("possible_version", F.transform("__from", lambda p: F.coalesce(F.try_element_at("__of", p), F.col(version)))).drop("__from", "__of")
