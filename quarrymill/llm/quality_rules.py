"""Quality rules whose cutoffs carry a guarantee: few good documents are rejected, in every stratum.

Each rule compares a ratio of integer counts with a cutoff. For a cutoff, a stratum has n labelled good documents
of which k would be rejected. The exact binomial test asks for P(X <= k | n, alpha / rules) <= delta / m, which is
the same as a Clopper-Pearson upper bound on the rule's false rejection rate of at most alpha / rules at level
1 - delta / m. Cutoffs of a rule are tried in a fixed order from lax to strict and the last one before the first
failure is taken; fixed-sequence testing needs no correction within a rule, and Bonferroni over the m = rules x
strata sequences covers the rest. So with probability 1 - delta the rules together reject at most alpha of every
stratum's good documents, at any size; the base checks are given and not part of that. A stratum with too few labels
gets no cutoffs, and nothing there is rejected by a rule.

Everything is DataFrame operations. The counts of a text are array expressions linear in its length (a sort of
window hashes apart); they are stored once, as a few integers a row, for calibration and verdict.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import stored, table, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Rejects where 1000 * part > cutoff * whole; cutoffs from lax to strict."""

    name: str
    part: str
    whole: str
    cutoffs: tuple[int, ...]


@dataclass(frozen=True)
class Policy:
    """alpha: false rejections that the rules together may make in a stratum, in equal shares. delta: chance that they make more."""

    alpha: float = 0.05
    delta: float = 0.05
    rules: tuple[Rule, ...] = field(
        default=(
            Rule("symbols", "n_symbols", "word_chars", (500, 300, 200, 150, 100, 70, 50)),
            Rule("upper", "n_upper", "word_chars", (600, 400, 300, 200, 150, 120)),
            Rule("dup_lines", "n_dup_lines", "n_lines", (600, 500, 400, 300, 250, 200)),
            Rule("repeats", "n_repeat_words", "n_words", (280, 250, 220, 200, 180)),
            Rule("word_length", "word_chars", "n_words", (30000, 24000, 20000, 16000, 14000)),
        )
    )

    @property
    def share(self) -> float:
        """False rejections that one rule may make."""
        return self.alpha / len(self.rules)


def text_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in keep, then the integer counts of each text (null: the empty text).

    A window that occurs twice or more is found by sorting the hashes of all windows of the text with their
    positions, and only in texts where hashes repeat at all. Hashes have 64 bits and are compared within a text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(*keep, text.alias("__t")).withColumns(
        {
            "__w": words(F.col("__t")),
            "__lines": F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")),
        }
    )
    df = df.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[A-Z]+", ""))).cast("long").alias("n_upper"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("__w") > WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("__w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, WINDOW))),
        ).alias("__win"),
    )
    df = df.withColumn(
        "__pairs",
        F.when(
            F.size(F.array_distinct("__win")) < F.size("__win"),
            F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("__win")
    same = lambda x, i, step: F.coalesce(F.get("__pairs", i + step)["h"] == x["h"], F.lit(False))
    df = df.withColumn(
        "__at",
        F.sort_array(F.transform(F.filter("__pairs", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"])),
    ).drop("__pairs")
    covered = F.aggregate(
        F.transform("__at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__at")


def _log_gamma(x: Column) -> Column:
    """log of the gamma function for x >= 1: Stirling's series, shifted up by 8."""
    z = x + F.lit(8.0)
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + F.lit(float(i)))
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), where k <= n * p: summed down from k until terms vanish in a double."""
    log_top = _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p)
    terms = F.least(k, F.ceil(12 * F.sqrt(k + 1.0)) + 50).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def down(acc: Column, i: Column) -> Column:
        j = k - i + 1.0
        term = acc["term"] * j / (n - j + 1.0) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    return F.exp(log_top) * F.aggregate(steps, start, down, lambda a: a["total"])


def cutoffs(counts: DataFrame, good: DataFrame, stratum: str, policy: Policy = Policy(), id_col: str = "doc_id") -> DataFrame:
    """One row per stratum: __stratum and a column c_<rule> with its cutoff, null where none is certified.

    counts has the id, the stratum and the counts; good has the ids of labelled good documents. Rows with a null
    id are no holdouts. The result has as many rows as there are strata among holdouts.
    """
    rejects = {(r.name, c): F.count_if(1000 * F.col(r.part) > c * F.col(r.whole)).alias(f"k_{r.name}_{c}") for r in policy.rules for c in r.cutoffs}
    held = good.select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct()
    seen = (
        counts.join(held, counts[id_col] == held["__id"], "left_semi")
        .groupBy(F.col(stratum).alias("__stratum"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"), *rejects.values())
    )
    # Holdouts are counted once: a few rows, each a stratum; their number is a scalar of the same table.
    seen = stored(seen)
    m = len(policy.rules) * max(1, seen.count())
    tries = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("step"), F.lit(c).cast("long").alias("cutoff"), F.col(f"k_{r.name}_{c}").cast("double").alias("k"))
        for r in policy.rules
        for i, c in enumerate(r.cutoffs)
    ]
    tried = seen.select("__stratum", "n", F.explode(F.array(*tries)).alias("x")).select("__stratum", "n", "x.*")
    safe = F.when(F.col("k") <= policy.share * F.col("n"), binomial_tail(F.col("k"), F.col("n"), policy.share) <= policy.delta / m).otherwise(False)
    sequences = tried.groupBy("__stratum", "rule").agg(
        F.min(F.when(~safe, F.col("step"))).alias("failed"), F.array_sort(F.collect_list(F.struct("step", "cutoff"))).alias("steps")
    )
    taken = F.element_at(F.filter("steps", lambda x: F.col("failed").isNull() | (x["step"] < F.col("failed"))), -1)["cutoff"]
    chosen = sequences.withColumn("cutoff", F.when(F.coalesce(F.col("failed"), F.lit(1)) > 0, taken))
    return chosen.groupBy("__stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"c_{r.name}") for r in policy.rules])


def judged(docs: DataFrame, labels: DataFrame, policy: Policy = Policy(), id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, stratum, counts, base_failed, kept and rejected_by (names of rules, base among them).

    Nulls: a null text is empty and so fails the base; a null stratum is a stratum of its own; documents with a
    null id are judged but are no holdouts. Labels other than 1, repeated or without document change nothing.
    Empty tables give no rows. Repeated rows are judged alike.
    """
    counts = stored(text_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("body")), "body", ("doc_id", "stratum")))
    good = labels.where(F.col("quality") == 1).select(F.col(id_col).alias("doc_id"))
    limits = cutoffs(counts, good, "stratum", policy)
    return _with_verdict(counts, limits, "stratum", policy)


def _with_verdict(counts: DataFrame, limits: DataFrame, stratum: str, policy: Policy) -> DataFrame:
    """counts with base_failed, kept and rejected_by; limits has a row per stratum."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    hits = [F.when(1000 * F.col(r.part) > F.col(f"c_{r.name}") * F.col(r.whole), F.lit(r.name)) for r in policy.rules]
    return (
        counts.join(limits, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
        # One condition over both sides of the join: a filter on kept isn't copied into the expressions of counts.
        .withColumns({"base_failed": base, "rejected_by": F.array_compact(F.array(F.when(base, F.lit("base")), *hits))})
        .withColumn("kept", F.size("rejected_by") == 0)
        .drop("__stratum", *[f"c_{r.name}" for r in policy.rules])
    )


def kept(docs: DataFrame, labels: DataFrame, policy: Policy = Policy(), id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of docs that judged() keeps, with all their columns; texts are not moved.

    Counts are stored beside the rows, so that texts are counted once, for cutoffs and verdict alike. Nulls, ties,
    repeated rows and empty tables are as in judged().
    """
    good = labels.where(F.col("quality") == 1).select(F.col(id_col).alias("doc_id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("body"))
    counts = stored(text_counts(rows, "body", ("row", "doc_id", "stratum")))
    limits = stored(cutoffs(counts.drop("row"), good, "stratum", policy))
    return _with_verdict(counts, limits, "stratum", policy).where("kept").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle(policy: Policy = Policy()) -> str:
    ks = ", ".join(f"count(*) FILTER (1000 * {r.part} > {c} * {r.whole}) AS k_{r.name}_{c}" for r in policy.rules for c in r.cutoffs)

    def ok(r: Rule, c: int) -> str:
        k = f"k_{r.name}_{c}"
        term = f"exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({policy.share}) + (n - j) * ln(1 - {policy.share}))"
        return f"({k} <= {policy.share} * n AND list_sum(list_transform(range(0, {k} + 1), lambda j: {term})) <= {policy.delta} / ({len(policy.rules)} * (SELECT count(*) FROM seen)))"

    def best(r: Rule) -> str:
        cases = "".join(
            " WHEN " + " AND ".join(ok(r, x) for x in r.cutoffs[: i + 1]) + f" THEN {r.cutoffs[i]}" for i in reversed(range(len(r.cutoffs)))
        )
        return f"CASE{cases} END AS c_{r.name}"

    hits = " OR ".join(f"coalesce(1000 * {r.part} > c_{r.name} * {r.whole}, false)" for r in policy.rules)
    return rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l
  FROM documents),
win AS (SELECT doc_id, generate_subscripts(v, 1) AS i, unnest(v) AS h FROM (
  SELECT doc_id, list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS v FROM w WHERE len(w) > {WINDOW})),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nx - i, {WINDOW})))::BIGINT AS n FROM (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM dup) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
seen AS (SELECT lang, count(*) AS n, {ks} FROM f WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang),
lim AS (SELECT lang AS stratum, {", ".join(best(r) for r in policy.rules)} FROM seen),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f LEFT JOIN lim ON f.lang IS NOT DISTINCT FROM lim.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({hits}) AS kept FROM b
"""


OP1_SQL = _oracle()
