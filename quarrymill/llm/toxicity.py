"""Toxicity by noisy-channel deobfuscation.

A word that may be disguised (leetspeak, marks between letters, repeated letters, letters spaced out) is a
lattice: each character may stand for several letters, for itself, or be noise. The Viterbi search over all states
(the last three symbols put out) finds the path that is best under the channel's costs and a character language
model of four symbols. The model's counts cover all documents; its table has 32**4 entries whatever the corpus. A
word without suspicious characters has one path, itself, and is not searched; one with a letter twice in a row, or
with signs at its edges that may be letters, is taken both as it is and as searched. When documents are scored, a
lattice is not searched if none of its paths could score more than the document's other words do.

Restored words are scored by whole word and prefixes. Evidence of a prefix is a lower confidence bound of its log
odds between toxic and other documents, learned from labelled documents; a document has the evidence of its
strongest word, mapped to a probability on labelled documents that the evidence was not learned from. At most
FIT_ROWS labelled documents, those with the smallest hashes of their ids, are used for fitting; this bounds what is
collected and broadcast. Every whole text is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log, prod, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import map_arrow, stored, table

FIT_ROWS = 40_000
SYMBOLS = 32
MIN_TOXIC = 4
PREFIXES = range(3, 9)
Z = 1.25
FEW = 32
MEMO = 250_000
ROWS = 128

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "aeiou"}
AS_LETTER, AS_ITSELF, AS_NOISE, AS_REPEAT = 0.7, 3.0, 1.2, 0.7
#: Letters with a digit or a sign inside or a letter three times in a row.
_ODD = re.compile(r"[^\W\d_][^\s]*(?:[\d_]|[^\w\s])[^\s]*[^\W_]|[\d@$][^\s]*[^\W\d_]|[^\W\d_][^\s]*[\d@$]|([^\W\d_])\1\1")
_EDGE = re.compile(r"^[^\w@$]+|[^\w$@]+$|(?:[$@]{2,}|[^\w\s]*[^\w\s$@][^\w\s]*)$")
#: Single characters set apart by blanks, which may have a mark before or between them.
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|])(?:(?:[._*\-]?[ \t]{1,2}|[ \t][._*\-][ \t]?)(?:[^\W_]|[@$!|])){2,}(?=[_*\-]?(?:\s|$)|[.,;:!?\"')\]}])")


_TWICE = re.compile(r"([^\W\d_])\1")
#: Edges but signs that may stand for letters.
_OUTER = re.compile(r"^[^\w@$!|+€£(*#]+|[^\w@$!|+€£(*#]+$")
_MARKS = ".,;:?\"')[]{}"
#: For a quick look: white space and marks, the rest, and no bytes after a character's first.
_SHAPE, _REST = bytes(32 if i in b"\t\n\v\f\r\x1c\x1d\x1e\x1f ._*-,;:?\"')]}" else 120 for i in range(256)), bytes(range(128, 192))


def spaced_out(text: str) -> list[str]:
    """Stretches of single characters with white space and marks between them, put together. text is lower-case."""
    # Whatever _SPACED matches passes the quick look; ! is a character of a stretch or ends it.
    plain = text if text.isascii() else " ".join(text.split())
    shape = b" " + b" ".join(plain.encode("utf-8", "surrogatepass").translate(_SHAPE, _REST).split()) + b" "
    if (b" x x x" if "!" in text else b" x x x ") not in shape:
        return []
    return [re.sub(r"[\s._*\-]+", "", m[0]) for m in _SPACED.finditer(text)]


def symbol(c: str) -> int:
    """0 a border, 1-26 a-z, 27 another letter, 28 a digit, 29 a sign."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 0 if c.isspace() else 27 if c.isalpha() else 28 if c.isdigit() else 29


def _byte_symbols():
    import numpy as np

    out = np.full(256, 29, np.int32)
    out[[9, 10, 11, 12, 13, 32, 0]] = 0
    out[48:58] = 28
    for i in range(26):
        out[65 + i] = out[97 + i] = i + 1
    out[192:] = 27
    out[128:192] = -1  # the rest of a character
    return out


def character_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """code, n: how often each four symbols follow each other in all texts; all before a border is border."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        of, total = _byte_symbols(), np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                texts = [b"   " + t.encode() + b" " for t in batch.column(0).slice(start, ROWS).to_pylist() if t]
                s = of[np.frombuffer(b"".join(texts), np.uint8)]
                s = s[s >= 0]
                if len(s) > 3:
                    near = s[2:-1]
                    middle = s[1:-2] * (near > 0)  # nothing before a border counts
                    total += np.bincount(((s[:-3] * (middle > 0) * SYMBOLS + middle) * SYMBOLS + near) * SYMBOLS + s[3:], minlength=SYMBOLS**4)
        codes = np.nonzero(total)[0]
        for start in range(0, len(codes), 100_000):
            part = codes[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["code", "n"])

    return map_arrow(docs.select(text_col), run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts):
    """Costs, -log p of the fourth symbol after three, by code: each order smoothed by the one below."""
    import numpy as np

    n = np.zeros(SYMBOLS**4)
    n[counts["code"]] = counts["n"]
    n = n.reshape((SYMBOLS,) * 4)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(4):
        c = n.sum(axis=tuple(range(3 - order))) if order < 3 else n
        p = (c + 5 * p) / (c.sum(axis=-1, keepdims=True) + 5)
    return (-np.log(p)).astype(np.float32).ravel()


@lru_cache(maxsize=4096)
def _options(c: str, again: bool) -> list[tuple[str, float, int]]:
    """What a character of a disguised word may stand for: (character or nothing, cost, symbol). again: it repeats the one before."""
    kind = symbol(c)
    out = [(x, AS_LETTER, symbol(x)) for x in LEET.get(c, "")] + [("", AS_NOISE, 0)] if kind in (0, 28, 29) else []
    out.append((c, 0.0 if 0 < kind < 28 else AS_ITSELF, kind))
    return [*out, ("", AS_REPEAT, 0)] if again and 0 < kind < 28 else out


def restore(word: str, costs) -> str:
    """The most likely word behind a lower-case disguised one. Of equally likely ones the first in the order of options."""
    steps = [_options(c, c == b) for b, c in zip(" " + word, word)]
    if len(word) < 64 and prod(map(len, steps)) <= FEW:
        return _best_of_few(steps, costs)
    # For each state, the last three symbols, the cheapest way there: (cost, last character put out, the way before).
    ways: dict[int, tuple] = {0: (0.0, "", None)}
    for options in steps:
        step: dict[int, tuple] = {}
        for past, way in ways.items():
            cost = way[0]
            for x, price, s in options:
                if x:
                    code = past * SYMBOLS + s
                    total, state = cost + price + float(costs[code]), code % SYMBOLS**3 if s else 0
                    if state not in step or total < step[state][0]:
                        step[state] = (total, x, way)
                else:
                    total = cost + price
                    if past not in step or total < step[past][0]:
                        step[past] = (total, way[1], way[2])
        ways = step
    return _spelled(min(ways.values(), key=lambda w: w[0]))


def _best_of_few(steps: list[list[tuple[str, float, int]]], costs) -> str:
    """restore() where all paths are few enough to go through each."""
    ways = [(0.0, 0, "")]
    for options in steps:
        step = []
        for x, price, s in options:
            if x:
                for total, past, text in ways:
                    code = past * SYMBOLS + s
                    step.append((total + price + costs[code], code % SYMBOLS**3 if s else 0, text + x))
            else:
                step += [(total + price, past, text) for total, past, text in ways]
        ways = step
    return min(ways)[2]


def _spelled(way: tuple) -> str:
    out = []
    while way is not None:
        out.append(way[1])
        way = way[2]
    return "".join(reversed(out))


class Bounds:
    """The most that any path of a lattice can score."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.starts = {f[:n] for f in weights for n in range(1, len(f) + (f[-1] != "$"))}  # of features, without the end of whole words

    def evidence(self, word: str) -> float:
        """The largest weight of the features of a word."""
        weights, starts = self.weights, self.starts
        best = weights.get(word + "$", 0.0)
        for n in range(PREFIXES[0], min(PREFIXES[-1] + 1, len(word))):
            if (start := word[:n]) not in starts:
                break
            if (w := weights.get(start, 0.0)) > best:
                best = w
        return best

    def of(self, word: str) -> float:
        """Signs before the first letter may fall off, so that a path may start anew after them; so may signs at the end."""
        if word.isalpha() and len(made := _variants(word)) <= FEW:
            return max(map(self.evidence, made))
        made, best, before = {""}, 0.0, ""
        weights, starts = self.weights, self.starts
        for c in word:
            step = set()
            for x, _, _ in _options(c, c == before):
                if not x:
                    step |= made
                    continue
                for m in made:
                    y = m + x
                    if y in starts:
                        step.add(y)
                        if (w := weights.get(y, 0.0)) > best:
                            best = w
                if not x.isalnum():
                    step |= made
                    step.add("")
            made, before = step, c
            if not made:
                return best
        return max([best, *(weights.get(m + "$", 0.0) for m in made)])


def _readings(token: str) -> tuple[list[str], list[str]]:
    """(words as they stand, lattices to search) of a token; with signs at its edges that may be letters, or a letter twice in a row, there are several readings."""
    if (core := token.strip(_MARKS)).isalpha():
        twice = _TWICE.search(core)
        return [] if twice and _ODD.search(core) else [core], [core] if twice else []
    core, wide = _EDGE.sub("", token), _OUTER.sub("", token)
    odd = _ODD.search(core)
    plain = [] if odd else [w for w in re.split(r"[\W_]+", core) if w]
    return plain, ([core] if odd or _TWICE.search(core) else []) + ([wide] if wide != core and len(set(wide)) > 1 else [])


def _variants(word: str) -> list[str]:
    """A word of letters with repeated letters kept or dropped; more than FEW are not all there are."""
    parts, before = [""], ""
    for c in word:
        grown = [p + c for p in parts]
        if c == before:
            grown += parts
            if len(grown) > FEW:
                return grown
        parts, before = grown, c
    return parts


def _searched(lattice: str, costs) -> list[str]:
    return [w for part in restore(lattice, costs).split() if (w := _EDGE.sub("", part))]


def _restored(token: str, costs, bounds: Bounds | None = None) -> list[str]:
    """The words of a token, of each of its readings. bounds: lattices that can't hold a feature with weight may be left out."""
    plain, lattices = _readings(token)
    return list(dict.fromkeys([*plain, *(w for x in lattices if bounds is None or bounds.of(x) > 0 for w in _searched(x, costs))]))


def features(word: str) -> list[str]:
    return [word[:n] for n in PREFIXES if n < len(word)] + [word + "$"]


class Features(dict):
    """The features of a token's restored words, memoised; of all, or of the wanted."""

    def __init__(self, costs, wanted: set[str] | None = None):
        super().__init__()
        self.costs, self.wanted = costs, wanted
        self.bounds = None if wanted is None else Bounds(dict.fromkeys(wanted, 1.0))

    def of(self, words: list[str]) -> list[str]:
        wanted = self.wanted
        if wanted is None:
            return [f for w in words for f in features(w)]
        return [f for w in words if w[:3] in self.bounds.starts for f in features(w) if f in wanted]

    def __missing__(self, token: str) -> list[str]:
        x = self.of(_restored(token, self.costs, self.bounds))
        if len(token) < 48:
            if len(self) >= MEMO:
                self.clear()
            self[token] = x
        return x

    def document(self, text: str | None) -> set[str]:
        """The features of a whole text."""
        text = (text or "").lower()
        out = set().union(*map(self.__getitem__, set(text.split())))
        for x in spaced_out(text):
            if self.bounds is None or self.bounds.of(x) > 0:
                out.update(self.of(restore(x, self.costs).split()))
        return out


class Evidence(dict):
    """What tokens say, memoised: the evidence of the strongest of their words; or, as long as nothing asked for more,
    (bound of what a search may find, evidence without it, token)."""

    def __init__(self, weights: dict[str, float], costs):
        super().__init__()
        self.costs, self.older, self.bounds = costs, {}, Bounds(weights)
        self.of = self.bounds.evidence

    def __missing__(self, token: str):
        x = self.older.get(token)
        if x is None:
            plain, lattices = _readings(token)
            x = max([0.0, *map(self.of, plain)])
            if lattices and (bound := max(map(self.bounds.of, lattices))) > x:
                x = (bound, x, token)
        return self._kept(token, x)

    def _kept(self, token: str, x):
        if len(token) < 48:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[token] = x
        return x

    def document(self, text: str | None) -> float:
        """The evidence of the strongest word. Lattices are searched in falling order of their bounds, until none can add."""
        text = (text or "").lower()
        best, open_ = 0.0, [(b, 0.0, "", x) for x in spaced_out(text) if (b := self.bounds.of(x)) > 0]
        for token in set(text.split()):
            x = self[token]
            if x.__class__ is tuple:
                open_.append((*x, None))
                x = x[1]
            if x > best:
                best = x
        for bound, x, token, letters in sorted(open_, key=lambda o: (-o[0], o[2], o[3] or "")):
            if bound <= best:
                break
            if letters is not None:
                x = max([0.0, *map(self.of, restore(letters, self.costs).split())])
            else:
                x = max([x, *(self.of(w) for y in _readings(token)[1] for w in _searched(y, self.costs))])
                self._kept(token, x)
            best = max(best, x)
        return best


def _counted(rows: DataFrame, costs, wanted: set[str] | None) -> dict[str, int]:
    """In how many documents of rows (text) each feature is; of all features in MIN_TOXIC or more, or of the wanted."""
    shared = rows.sparkSession.sparkContext.broadcast((costs, wanted))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        costs, wanted = shared.value
        counts, memo = Counter(), Features(costs.tolist(), wanted)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                for text in batch.column(0).slice(start, ROWS).to_pylist():
                    counts.update(memo.document(text))
        rows = list(counts.items())
        for start in range(0, len(rows), 50_000):
            part = rows[start : start + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int64())], ["f", "n"])

    found = map_arrow(rows.select("text"), run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    return {r["f"]: r["n"] for r in (found.where(F.col("n") >= MIN_TOXIC) if wanted is None else found).collect()}


def _measured(rows: DataFrame, weights: dict[str, float], costs, keep: tuple[str, ...]) -> DataFrame:
    """The columns keep of rows with evidence of text."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, costs))
    df = rows.select(*keep, "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        weights, costs = shared.value
        memo = Evidence(weights, costs.tolist())
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = pa.array([memo.document(t) for t in part.column(len(keep)).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], x], [*keep, "evidence"])

    return map_arrow(df, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]) + ", evidence double")


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept for (evidence, label, count), by Newton's method with a small penalty."""
    import numpy as np

    x, y, n = (np.array(v, float) for v in zip(*points, strict=True))
    beta, design = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        slope = design.T @ (n * (y - p)) - 0.1 * beta
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), slope)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of docs: doc_id, held_out, evidence, score.

    Labels count where they are 0 or 1, the larger one of several; documents without id are scored but not held
    out, and teach nothing. Null and empty texts have no evidence. Without labels of both kinds the score is the
    share of 1 among the labels, or 0.5 without labels. Repeated rows are scored alike; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    taught = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .withColumn("part", remainder(F.col("doc_id"), 4))
        .where("part <> 2")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    costs = language_model(character_counts(rows).toPandas())
    # Of rows with one id a single one teaches, which bounds the sample by its ids.
    fit = stored(rows.join(F.broadcast(taught), "doc_id").where("text IS NOT NULL").groupBy("doc_id", "label", "part").agg(F.min("text").alias("text")))
    learn, check = fit.where("part <> 3"), fit.where("part = 3")
    toxic = _counted(learn.where("label = 1"), costs, None)
    clean = _counted(learn.where("label = 0"), costs, set(toxic))
    totals = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}
    weights = {}
    for f, t in toxic.items():
        c = clean.get(f, 0)
        odds = log((t + 0.5) / (totals.get(1, 0) + 1)) - log((c + 0.5) / (totals.get(0, 0) + 1))
        if (low := odds - Z * sqrt(1 / (t + 0.5) + 1 / (c + 0.5))) > 0:
            weights[f] = round(low, 6)
    points = [(r["x"], r["label"], r["count"]) for r in _measured(check, weights, costs, ("label",)).groupBy(F.round("evidence", 2).alias("x"), "label").count().orderBy("x", "label").collect()]
    seen = sum(p[2] for p in points)
    if len({p[1] for p in points}) == 2:
        slope, base = _logistic(points)
    else:
        share = sum(p[1] * p[2] for p in points) / seen if seen else 0.5
        slope, base = 0.0, log(min(max(share, 0.001), 0.999) / (1 - min(max(share, 0.001), 0.999)))
    score = 1 / (1 + F.exp(-(slope * F.col("evidence") + base)))
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return _measured(rows, weights, costs, ("doc_id",)).select("doc_id", held.alias("held_out"), "evidence", F.round(score, 9).alias("score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
