"""URL filter: rules first, then the ratio of two character language models.

A rule fits a host, its subdomains and paths that start with the rule's; the longest rule decides. URLs that a
rule decides are the examples: allowed ones train the accepted model, blocked ones the rejected model, but for a
fifth that is held out by a hash of the URL. A model predicts each byte of the whole URL, query and fragment
included, from the up to ORDER bytes before it, with variable order: a context's estimate is smoothed by that of the
next shorter one, and a context never seen passes its shorter one on. The score is the difference of log-likelihoods
for a byte. The cutoff is calibrated on held-out URLs: it lies between the two kinds, and at most SPARE of the
accepted ones score below it.

Counts are hashed into SLOTS slots for each model, so what is collected and broadcast is four arrays of SLOTS
four-byte numbers (32 MB) however many URLs there are; `Models.filled` says how many slots are in use.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import map_arrow, mixed, table

ORDER = 5
SLOTS = 1 << 21
PART = 1 << 16
URLS = 512
WEIGHT = 2.0
SPARE = 0.05
HELD_OUT = 5
GRID = 1000


@dataclass(frozen=True)
class Rule:
    """verdict (allow or block) for a host with its subdomains and paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty for null and for text without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url (empty for null), host, path, rule (name of the longest that fits), decided (its verdict); nulls where none fits. Of rules of one length the first by name decides."""
    df = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    host, path = url_parts(F.col("url"))
    df = df.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return df.select("page_id", "url", "host", "path", name.alias("rule"), verdict.alias("decided"))


def _slots(urls: list[bytes]):
    """(for each order the slots of contexts, for each order those of contexts with the next byte, where URLs start): one column for each byte of each URL and its end."""
    import numpy as np

    data = np.frombuffer(b"".join(b"\x02" * ORDER + u + b"\x03" for u in urls), np.uint8).astype(np.uint64)
    sizes = np.array([len(u) + 1 for u in urls], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.arange(sizes.sum()) + ORDER * (np.repeat(np.arange(len(urls)), sizes) + 1)
    context, contexts, wholes = np.zeros(len(at), np.uint64), [], []
    for k in range(ORDER + 1):
        if k:
            context = context * np.uint64(0x100000001B3) + data[at - k] + np.uint64(1)
        contexts.append((mixed(context + np.uint64(k << 56)) % np.uint64(SLOTS)).astype(np.int64))
        wholes.append((mixed((context + np.uint64(k << 56)) * np.uint64(257) + data[at] + np.uint64(1)) % np.uint64(SLOTS)).astype(np.int64))
    return contexts, wholes, starts


def trained(urls: DataFrame) -> DataFrame:
    """Counts for a model in parts of PART slots: decided, kind (0 context, 1 context with the next byte), part, data. urls: decided, url."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        counts: dict = {}
        for batch in batches:
            for start in range(0, batch.num_rows, URLS):
                verdicts, found = (c.slice(start, URLS).to_pylist() for c in batch.columns)
                for verdict in set(verdicts):
                    slots = _slots([u.encode() for v, u in zip(verdicts, found, strict=True) if v == verdict])
                    for kind in (0, 1):
                        table = counts.setdefault((verdict, kind), np.zeros(SLOTS, np.int64))
                        for x in slots[kind]:
                            np.add.at(table, x, 1)
        for (verdict, kind), held in counts.items():
            slot = np.nonzero(held)[0]
            for start in range(0, len(slot), 50_000):
                part = slot[start : start + 50_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([verdict] * n, pa.string()), pa.array([kind] * n, pa.int32()), pa.array(part.astype(np.int32)), pa.array(held[part])], ["decided", "kind", "slot", "n"])

    def joined(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        now, held = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([now[2]], pa.int32()), pa.array([held.tobytes()])], ["decided", "kind", "part", "data"])
        for batch in batches:
            for verdict, kind, part, slot, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (verdict, kind, part) != now:
                    if now:
                        yield row()
                    now, held = (verdict, kind, part), np.zeros(PART, np.float32)
                held[slot % PART] = n
        if now:
            yield row()

    each = map_arrow(urls.select("decided", "url"), run, "decided string, kind int, slot int, n long").groupBy("decided", "kind", "slot").agg(F.sum("n").alias("n"))
    placed = each.select("decided", "kind", F.floor(F.col("slot") / PART).cast("int").alias("part"), "slot", "n").repartition("decided", "kind", "part").sortWithinPartitions("decided", "kind", "part")
    return map_arrow(placed, joined, "decided string, kind int, part int, data binary")


class Models:
    """Both models as arrays of counts by slot. parts: rows of trained()."""

    def __init__(self, parts):
        import numpy as np

        self.tables = {v: [np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32)] for v in ("allow", "block")}
        for verdict, kind, part, data in parts:
            self.tables[verdict][kind][part * PART : (part + 1) * PART] = np.frombuffer(data, np.float32)
        self.ready = all(t[0].any() for t in self.tables.values())
        self.filled = {v: [float((x > 0).mean()) for x in t] for v, t in self.tables.items()}

    def scores(self, urls: list[bytes]):
        """Mean over bytes of log p(accepted) - log p(rejected) for each URL; 0 without examples of both."""
        import numpy as np

        if not self.ready or not urls:
            return np.zeros(len(urls))
        contexts, wholes, starts = _slots(urls)
        logs = {}
        for verdict, (seen, followed) in self.tables.items():
            p = np.full(len(contexts[0]), 1 / 256)
            for c, w in zip(contexts, wholes, strict=True):
                p = (followed[w] + WEIGHT * p) / (seen[c] + WEIGHT)
            logs[verdict] = np.log(np.clip(p, 1e-12, 1.0))
        sizes = np.diff(np.append(starts, len(contexts[0])))
        return np.round(np.add.reduceat(logs["allow"] - logs["block"], starts) / sizes, 9)


def scored(urls: DataFrame, models: Models) -> DataFrame:
    """urls (any columns, among them url, not null) with score."""
    shared = urls.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, URLS):
                part = batch.slice(start, URLS)
                score = pa.array(shared.value.scores([u.encode() for u in part.column("url").to_pylist()]), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, score], [*part.schema.names, "score"])

    return map_arrow(urls, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields) + ", score double")


def _cutoff(bins: list[tuple[str, int, int]]) -> float | None:
    """From held-out (verdict, score * GRID, count): half-way from where all but SPARE of the rejected end to where all but SPARE of the accepted begin; where the two overlap, the latter."""

    def passed(verdict: str, ascending: bool) -> int | None:
        rows = sorted(((b, n) for v, b, n in bins if v == verdict), reverse=not ascending)
        spare = SPARE * sum(n for _, n in rows)
        for b, n in rows:
            spare -= n
            if spare < 0:
                return b
        return None

    accepted, rejected = passed("allow", True), passed("block", False)
    if accepted is None:
        return None
    return (min(accepted, rejected if rejected is not None else accepted) + accepted) / 2 / GRID


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict (allow or block), score.

    Null URLs and text without :// have an empty host and path; the models judge what text there is. Without
    examples of both kinds all URLs that no rule decides are allowed. Repeated rows and null ids are judged alike;
    other columns are ignored; no rows give no rows.
    """
    df = ruled(pages, rules, id_col, url_col)
    examples = df.where("decided IS NOT NULL")
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    models = Models([tuple(r) for r in trained(examples.where(~held)).collect()])  # 4 * SLOTS / PART rows at most
    bins = scored(examples.where(held).select("decided", "url"), models)
    at = F.floor(F.least(F.greatest(F.col("score"), F.lit(-30.0)), F.lit(30.0)) * GRID).alias("bin")
    cutoff = _cutoff([tuple(r) for r in bins.groupBy("decided", at).count().collect()])  # at most 2 * 60 * GRID rows
    own = F.when(F.lit(models.ready and cutoff is not None) & (F.col("score") < F.lit(cutoff or 0.0)), "block").otherwise("allow")
    return scored(df, models).select("page_id", "host", "path", "rule", F.coalesce("decided", own).alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
