"""Agreement of raters, precision and recall of rated items, defects by severity."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("Sufficiency", "Completeness", "Verbosity", "Hallucinations")


def kappa(df: DataFrame, first: str, second: str, alpha: float = 0.05) -> DataFrame:
    """One row: n, kappa, low, high, with the asymptotic interval clamped to [-1, 1]. Pairs with a null are left out.

    Everything follows from the counts of pairs of labels, so one aggregation reads the ratings. Row and column
    marginals enter the variance crosswise where a cell lies off the diagonal as they do on it: p_i of the row's
    label as first, p_j of the column's label as second.
    """
    cells = df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(F.col(first).alias("i"), F.col(second).alias("j")).agg(F.count(F.lit(1)).alias("c"))
    every = Window.partitionBy(F.lit(1))
    cells = cells.withColumn("n", F.sum("c").over(every))
    rows = cells.groupBy(F.col("i").alias("label")).agg(F.sum(F.col("c") / F.col("n")).alias("pi"))
    cols = cells.groupBy(F.col("j").alias("label")).agg(F.sum(F.col("c") / F.col("n")).alias("pj"))
    both = rows.join(cols, "label", "full").na.fill(0.0, ["pi", "pj"])
    left, right = both.select(F.col("label").alias("i"), F.col("pi")), both.select(F.col("label").alias("j"), F.col("pj"))
    full = cells.join(left, "i").join(right, "j").withColumn("p", F.col("c") / F.col("n"))
    same = F.col("i") == F.col("j")
    sums = full.agg(
        F.first("n").alias("n"),
        F.coalesce(F.sum(F.when(same, F.col("p"))), F.lit(0.0)).alias("po"),
        F.coalesce(F.sum(F.when(same, F.col("p") * (F.col("pi") + F.col("pj")))), F.lit(0.0)).alias("d"),
        F.sum(F.col("p") * F.pow(F.col("pi") + F.col("pj"), 2)).alias("q"),
    ).crossJoin(both.agg(F.sum(F.col("pi") * F.col("pj")).alias("pe")))  # one row each
    po, pe = F.col("po"), F.col("pe")
    k = F.try_divide(po - pe, 1 - pe)
    off = F.nullif(1 - pe, F.lit(0.0))
    var = (po * (1 - po) / off**2 + 2 * (1 - po) * (2 * po * pe - F.col("d")) / off**3 + (1 - po) ** 2 * (F.col("q") - 4 * pe**2) / off**4) / F.col("n")
    half = F.sqrt(F.greatest(var, F.lit(0.0))) * NormalDist().inv_cdf(1 - alpha / 2)
    # Close to certain agreement by chance the interval is the value itself; at it there is no value.
    half = F.when(F.abs(1 - pe) <= 1e-5 + 1e-8, F.lit(0.0)).otherwise(half)
    value = lambda x: F.when(pe != 1, x)
    return sums.select("n", value(k).alias("kappa"), value(F.greatest(k - half, F.lit(-1.0))).alias("low"), value(F.least(k + half, F.lit(1.0))).alias("high"))


RATER_KEYS = ("sample_id", "task_id", "version", "repo", "node_id")


def finalized(annotations: DataFrame, annotator: str, tasks: Column | list | None = None) -> DataFrame:
    """Annotations of one annotator that are finalized, of these tasks (default: all)."""
    rows = annotations.where((F.col("annotator") == annotator) & (F.col("status") == "Finalized"))
    return rows if tasks is None else rows.where(F.col("task_id").isin(tasks))


def rated_items(annotations: DataFrame) -> DataFrame:
    """A row for each item of each label: keys of RATER_KEYS and label. nodes: map<label, array of items>; labels without items give none."""
    labels = annotations.select(*RATER_KEYS[:-1], F.explode("nodes").alias("label", "items"))
    return labels.select(*RATER_KEYS[:-1], F.explode("items").alias("node_id"), "label")


def rated_by_both(annotations: DataFrame, first: str, second: str, tasks: list | None = None) -> DataFrame:
    """Items that two annotators labelled: the keys, label_first, label_second. kappa() takes these."""
    one, two = (rated_items(finalized(annotations, a, tasks)) for a in (first, second))
    return one.withColumnRenamed("label", "label_first").join(two.withColumnRenamed("label", "label_second"), list(RATER_KEYS))


def split_share(graphs: DataFrame, messages: str = "messages") -> DataFrame:
    """One row: the share of graphs with several components, by their messages; null without graphs."""
    return graphs.agg(F.avg(F.exists(messages, lambda m: m["rule"] == "R24").cast("double")).alias("share"))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def label_counts(nodes: Column, labels: tuple[str, ...] = LABELS) -> list[Column]:
    """From map<label, array of items>: a column per label with its number of items; null without that label."""
    return [F.size(F.element_at(nodes, label)).cast("long").alias(label) for label in labels]


def sample_maxima(counts: DataFrame, key: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    return counts.groupBy(key).agg(*[F.max(label).alias(f"{label}_max") for label in labels])


def _rates(tp: Column, hard: Column, fp: Column, fn: Column, fn_hard: Column, of) -> list[Column]:
    return [
        of(tp, tp + fp).alias("precision"),
        of(hard, hard + fp).alias("hard_precision"),
        of(tp, tp + fn).alias("recall"),
        of(hard, hard + fn_hard).alias("hard_recall"),
        of(2 * tp, 2 * tp + fp + fn).alias("f1"),
        of(2 * hard, 2 * hard + fp + fn).alias("hard_f1"),
    ]


def _parts(c, m) -> tuple[Column, ...]:
    tp = c("Sufficiency") + c("Completeness")
    return tp, c("Sufficiency"), c("Verbosity") + c("Hallucinations"), m("Sufficiency") + m("Completeness") - tp, m("Sufficiency") - c("Sufficiency")


def micro(counts: DataFrame, maxima: DataFrame, experiment: str) -> DataFrame:
    """Rates from sums over all samples of an experiment, against sums of the maxima of all samples; rounded to 3 digits."""
    totals = maxima.agg(*[F.coalesce(F.sum(f"{x}_max"), F.lit(0)).alias(f"{x}_max") for x in LABELS])
    sums = counts.groupBy(experiment).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in LABELS]).crossJoin(F.broadcast(totals))  # a row
    rates = _rates(*_parts(F.col, lambda x: F.col(f"{x}_max")), lambda a, b: F.round(F.try_divide(a.cast("double"), b), 3))
    return sums.select(experiment, *rates)


def macro(counts: DataFrame, maxima: DataFrame, key: str, experiment: str) -> DataFrame:
    """Means of each sample's rates; a rate without value counts as 1; rounded to 3 digits."""
    joined = counts.join(maxima, key)
    rates = _rates(*_parts(F.col, lambda x: F.col(f"{x}_max")), lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(1.0)))
    each = joined.select(experiment, *rates)
    return each.groupBy(experiment).agg(*[F.round(F.avg(c), 3).alias(c) for c in each.columns[1:]])


def severities(messages: Column, failed: Column, how: str = "last") -> list[Column]:
    """Low, Medium, High of a graph from its messages (rule, description, severity, number) in order.

    how: "last" takes the number of the last message of a severity, "sum" adds them, "unique" counts 1. High is 1
    for a graph that could not be rendered.
    """

    def with_severity(level: str) -> Column:
        return F.filter(messages, lambda m: m["severity"] == level)

    out = []
    for level in ("Low", "Medium"):
        of = with_severity(level)
        value = {"last": F.get(of, F.size(of) - 1)["number"], "sum": F.aggregate(of, F.lit(0), lambda a, m: a + m["number"]), "unique": F.when(F.size(of) > 0, 1)}[how]
        out.append(F.coalesce(value, F.lit(0)).cast("double").alias(level))
    return [*out, failed.cast("double").alias("High")]


def defect_kinds(graphs: DataFrame, messages: str, failed: Column, n_nodes: Column, kinds: list[tuple[str, str | None]]) -> DataFrame:
    """defects() for each (how, average), with the column kind, from one pass over graphs."""
    hows = list(dict.fromkeys(how for how, _ in kinds))
    levels = ("Low", "Medium", "High")
    rows = graphs.select(n_nodes.alias("__n"), *[c.alias(f"{how} {level}") for how in hows for level, c in zip(levels, severities(F.col(messages), failed, how), strict=True)])
    mean = lambda how, average, level: F.avg(F.try_divide(F.col(f"{how} {level}"), F.col("__n")) if average == "macro" else F.col(f"{how} {level}"))
    sums = rows.agg(F.avg("__n").alias("__n"), *[mean(how, average, level).alias(f"{how} {average} {level}") for how, average in kinds for level in levels])
    of = lambda how, average, level: F.try_divide(F.col(f"{how} {average} {level}"), F.col("__n")) if average == "micro" else F.col(f"{how} {average} {level}")
    each = [F.struct(F.lit(f"{how} {average}").alias("kind"), *[of(how, average, level).alias(level) for level in levels]) for how, average in kinds]
    return sums.select(F.inline(F.array(*each)))


def defects(graphs: DataFrame, messages: str, failed: Column, n_nodes: Column, how: str = "last", average: str | None = None) -> DataFrame:
    """One row: mean Low, Medium, High over graphs. average: "macro" divides each graph's by its nodes, "micro" the means by the mean number of nodes; graphs without nodes give null."""
    rows = graphs.select(*severities(F.col(messages), failed, how), n_nodes.alias("__n"))
    value = (lambda c: F.try_divide(F.col(c), F.col("__n"))) if average == "macro" else F.col
    out = rows.agg(*[F.avg(value(c)).alias(c) for c in ("Low", "Medium", "High")], F.avg("__n").alias("__n"))
    if average == "micro":
        out = out.select(*[F.try_divide(F.col(c), F.col("__n")).alias(c) for c in ("Low", "Medium", "High")])
    return out.select("Low", "Medium", "High")
