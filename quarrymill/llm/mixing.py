"""Mixing sources to target weights by entropy balancing.

Document d of source s gets the rate r = min(cap, exp(L_s * size / mean_size_s)): of all rates up to the cap, the
ones closest to 1 in relative entropy whose tokens add up to the source's target. The multipliers L_s solve the
convex dual, whose Hessian is diagonal in the sources. Newton steps, kept inside a bracket, are distributed: rates
depend on source and size alone, so each iteration is one aggregation over the counts by (source, size), with
fixed-point sums that do not depend on the order of tasks. Rates become whole copies by systematic rounding in
order of size within a source, at the phase that fits its target best, so that rounding errors cancel and a source
misses its target by less than the size of its largest documents. No Python runs on executors, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import stored, table, words

UNIT = 1_000_000_000
CHUNK = 2048
PHASES = 64
EXACT = "decimal(38,0)"


def targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """Adds target to one row per source (source, source_size).

    Sources in order of code points, null last, take the weights in turn. They share share * all sizes by weight,
    up to cap * their size each; what is over goes to the others by weight. This is water-filling: in order of
    cap / weight the full sources come first, and the level follows from sums over them. The windows hold one
    row per source.
    """
    turn = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    df = totals.withColumn("w", w).withColumn("full", cap * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("full") / F.col("w"), F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy(F.lit(1))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns(
        {
            "rest": share * F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0)),
            "rest_w": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    )
    df = df.withColumn("level", F.col("rest") / F.col("rest_w"))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("full"), F.struct(F.col("full") / F.col("w"), F.col("level")))).over(every)
    level = first["level"]
    return df.withColumn("target", F.when(level.isNull(), F.col("full")).otherwise(F.least(F.col("full"), level * F.col("w")))).drop("w", "full", "rest", "rest_w", "level")


def _modulo(x: Column) -> Column:
    return F.pmod(x, F.lit(UNIT).cast(EXACT)).cast("long")


def _rate(multiplier: Column, size: Column, mean: Column, cap: int) -> Column:
    power = multiplier * size / mean
    return F.when(power > 0.7, F.least(F.lit(float(cap)), F.exp(F.least(power, F.lit(50.0))))).otherwise(F.exp(F.greatest(power, F.lit(-700.0))))


def multipliers(sizes: DataFrame, sources: DataFrame, cap: int = 2, tolerance: float = 1e-7, most: int = 60) -> DataFrame:
    """sources with multiplier: null where the target is the cap (rates are the cap), 0 where nothing is to be taken.

    sizes: key, size, n (documents of a source with a size). sources: key, source_size, source_docs, target.
    """
    state = sources.select(
        "key",
        (F.col("source_size") / F.col("source_docs")).alias("mean"),
        "target",
        F.lit(0.0).alias("multiplier"),
        F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"),
        (F.col("target") >= cap * F.col("source_size").cast("double")).alias("done"),
    )
    state = stored(state)
    fixed = lambda c: F.sum((c * 1e6).cast("decimal(38,0)"))
    for _ in range(most):
        rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean"), cap)
        tokens = F.col("n") * F.col("size") * rate
        sums = (
            sizes.join(state.where("NOT done").select("key", "mean", "multiplier"), "key")
            .groupBy("key")
            .agg(fixed(tokens).alias("got"), fixed(F.when(rate < cap, tokens * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
            .select("key", (F.col("got").cast("double") / 1e6).alias("got"), (F.col("slope").cast("double") / 1e6).alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        close = F.abs(gap) <= F.greatest(F.col("target") * tolerance, F.lit(0.01))
        lo = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("multiplier") - gap / F.col("slope"))
        inside = newton.isNotNull() & (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi)) & (F.abs(newton - F.col("multiplier")) <= 1 + F.abs(F.col("multiplier")))
        far = F.when(gap < 0, F.greatest(2 * F.col("multiplier"), F.lit(0.0)) + 1).otherwise(F.least(2 * F.col("multiplier"), F.lit(0.0)) - 1)
        step = F.when(inside, newton).when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).otherwise(far)
        moved = state.join(sums, "key", "left").select(
            "key",
            "mean",
            "target",
            F.when(F.col("done") | F.col("got").isNull() | close, F.col("multiplier")).otherwise(step).alias("multiplier"),
            lo.alias("lo"),
            hi.alias("hi"),
            (F.col("done") | F.col("got").isNull() | close).alias("done"),
        )
        state = stored(moved)
        if state.where("NOT done").isEmpty():
            break
    else:
        raise RuntimeError(f"the dual has not converged after {most} steps")
    full = F.col("target") >= cap * F.col("source_size").cast("double")
    return sources.join(state.select("key", "mean", "multiplier"), "key").withColumn("multiplier", F.when(~full, F.col("multiplier")))


def mixed(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, rate, copies, taken.

    size: number of words unless given. A null text has size 0; documents of size 0 keep one copy, which takes no
    words. Null is a source like others. Repeated rows and null ids are documents of their own; which of several
    rows with one id, source and size gets the extra copy is not told apart. Empty tables give no rows.
    """
    size = F.size(words(F.col(text_col))) if size is None else size
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("null")).alias("key"),
            size.cast("long").alias("size"),
        )
    )
    sizes = stored(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source")))
    totals = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("source_docs"))
    sources = stored(targets(totals, weights, share, cap))
    solved = multipliers(sizes, sources, cap).select("key", "source_size", "target", "mean", "multiplier")

    unit = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("multiplier").isNull(), F.lit(float(cap))).otherwise(_rate(F.col("multiplier"), F.col("size"), F.col("mean"), cap))
    by_size = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        sizes.select("key", "size", "n")
        .join(solved, "key")
        .withColumn("unit", F.round(unit * UNIT).cast("long"))
        .withColumn("start", _modulo(F.coalesce(F.sum((F.col("n") * F.col("unit")).cast(EXACT)).over(by_size), F.lit(0).cast(EXACT))))
        .withColumn("chunks", F.ceil(F.col("n") / CHUNK))
    )
    plan = stored(plan.select("key", "size", "n", "source_size", "target", "unit", "chunks", "start"))
    # Any phase of the rounding is fair; the one with the smallest error is taken for each source.
    phase = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PHASES - 1)), lambda i: (i * (UNIT // PHASES)).cast("long"))).alias("phase")
    whole = lambda x: F.floor(x / F.lit(UNIT).cast(EXACT)).cast(EXACT)
    first, last = (F.col("start") + F.col("phase")).cast(EXACT), F.col("n").cast(EXACT) * F.col("unit").cast(EXACT)
    taken = (whole(first + last) - whole(first)) * F.col("size")
    best = (
        plan.select("key", "size", "n", "unit", "start", "target", phase)
        .groupBy("key", "phase")
        .agg(F.sum(taken.cast(EXACT)).alias("taken"), F.first("target").alias("target"))
        .groupBy("key")
        .agg(F.min(F.struct(F.abs(F.col("taken").cast("double") - F.col("target")).alias("gap"), "phase"))["phase"].alias("phase"))
    )
    plan = plan.join(best, "key").withColumn("start", F.col("start") + F.col("phase")).drop("phase", "n")
    dealt = rows.join(plan, ["key", "size"]).withColumn("h", F.xxhash64("doc_id")).withColumn("chunk", F.pmod("h", "chunks"))
    # Else the join's partitioning by key and size would do for the windows, and keep a group's chunks together.
    dealt = dealt.repartition("key", "size", "chunk")
    # Groups of one source and size are dealt to chunks of bounded size; a chunk starts where the ones before end.
    counts = dealt.where("chunks > 1").groupBy("key", "size", "chunk").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("key", "size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    skipped = counts.select("key", "size", "chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("skip"))
    within = Window.partitionBy("key", "size", "chunk").orderBy("h", "doc_id")
    placed = dealt.join(skipped, ["key", "size", "chunk"], "left").withColumn("k", F.row_number().over(within) - 1)
    at = _modulo(F.col("start") + F.coalesce(F.col("skip"), F.lit(0)).cast(EXACT) * F.col("unit")) + F.col("k") * F.col("unit")
    copies = F.floor((at + F.col("unit")) / UNIT) - F.floor(at / UNIT)
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("unit") / UNIT).alias("rate"),
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix: each row of docs as often as mixed() copies it, with all its columns.

    A row is known by its id and a hash of its columns (but maps), so that which of several rows with one id is
    taken does not depend on the run. Rows alike in all that are numbered on both sides, and each gets its own
    copies. Texts are moved once, by that key. Nulls and empty tables are as in mixed(); names may clash.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(*plain).alias("h"))
    sized = docs.select(key.alias("key"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    number = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))).alias("k")
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("*", number).alias("a")
    taken = mixed(sized, F.col("size"), weights, share, cap, "key", "source").select(F.col("doc_id").alias("key"), "copies").select("*", number).where("copies > 0").alias("b")
    # Numbers are compared as a range: as a key they would have the rows dealt a second time.
    same = (F.col("a.key") == F.col("b.key")) & F.col("a.k").between(F.col("b.k"), F.col("b.k"))
    repeated = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("again")
    return rows.join(taken, same).select("row", repeated).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
