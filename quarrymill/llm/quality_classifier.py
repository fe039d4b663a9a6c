"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes; its label says nothing of which passages are bad. Each passage
is described by what its bytes show (kinds of characters, their neighbours, repetition, hashed runs of four bytes), encoded by one layer, and
gets a gated attention weight: softmax over the document of w . (tanh(V h) * sigmoid(U h)). The weighted sum of
encodings gives the score. Encoder, attention and output are learned together from document labels alone, with
numpy on the driver, from whole labelled documents in order of the hashes of their ids: at most FIT_ROWS of them,
as far as they make up at most FIT_PASSAGES passages together; these bounds hold for fitting only. Scores use every
passage of every text. The model is a few thousand numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import map_arrow, stored, table

PASSAGE = 512
FIT_ROWS, FIT_PASSAGES = 16_000, 400_000
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 14, 128, 0.01, 1e-4
SIGNS = b"#*$%&|<>"
BINS = 256
SLICE = PASSAGE * 512


def _kinds():
    """A class for each byte: 0 space, 1 line end, 2 lower case, 3 upper case, 4 digit, 5 other letters, 6-9 . , ! ?, 10-17 the signs, 18 other."""
    import numpy as np

    out = np.full(256, 18, np.int64)
    out[[9, 11, 12, 13, 32]] = 0
    out[10] = 1
    out[97:123], out[65:91], out[48:58], out[128:] = 2, 3, 4, 5
    for i, c in enumerate(b".,!?"):
        out[c] = 6 + i
    for i, c in enumerate(SIGNS):
        out[c] = 10 + i
    return out


KINDS = 19
GRAMS = 32
FEATURES = KINDS + 7 + GRAMS


def _described(data: bytes, sizes: list[int]):
    """Features of passages with these sizes that make up data."""
    import numpy as np

    b = np.frombuffer(data, np.uint8)
    n = np.array(sizes, np.int64)
    at = np.repeat(np.arange(len(n)), n)
    kind = _kinds()[b]
    counts = np.bincount(at * KINDS + kind, minlength=len(n) * KINDS).reshape(-1, KINDS).astype(float)
    inside = at[1:] == at[:-1]
    before, after = kind[:-1], kind[1:]
    per = lambda mask: np.bincount(at[1:][mask & inside], minlength=len(n)).astype(float)
    space, sign = before <= 1, after >= 9
    starts = per(space & (after > 1))
    grams = (b[:-3].astype(np.int64) * 31 + b[1:-2]) * 31 + b[2:-1].astype(np.int64) * 7 + b[3:] if len(b) > 3 else np.zeros(0, np.int64)
    whole = at[3:] == at[:-3] if len(b) > 3 else np.zeros(0, bool)
    bins = np.bincount((at[:-3][whole] * BINS + (grams[whole] * 2654435761 >> 12) % BINS) if len(b) > 3 else np.zeros(0, np.int64), minlength=len(n) * BINS).reshape(-1, BINS)
    held = np.maximum(bins.sum(axis=1), 1)
    size = np.maximum(n, 1).astype(float)
    extra = [
        np.log(size / PASSAGE + 0.02),
        (size - counts[:, 0] - counts[:, 1]) / (starts + 1) / 10,
        per((before >= 2) & (before <= 5) & sign) / size * 10,
        per((b[1:] == b[:-1]) & sign) / size * 10,
        per(space & (after == 3)) / (starts + 1),
        (bins > 0).sum(axis=1) / (BINS * (1 - np.exp(-held / BINS))),
        (bins.astype(float) ** 2).sum(axis=1) / held / np.maximum(1, held / BINS) / 10,
    ]
    grams = np.sqrt(bins.reshape(len(n), GRAMS, -1).sum(axis=2) / held[:, None])
    return np.column_stack([np.sqrt(counts / size[:, None]), *extra, grams]).astype(np.float32)


def passages(texts: list[str | None]):
    """(features of all passages in order, number of passages of each text). An empty text has one empty passage."""
    import numpy as np

    out, data, sizes, numbers = [], [], [], []
    held = 0

    def flush() -> None:
        nonlocal held
        if sizes:
            out.append(_described(b"".join(data), sizes))
        data.clear()
        sizes.clear()
        held = 0

    for text in texts:
        raw = (text or "").encode()
        numbers.append(max(1, -(-len(raw) // PASSAGE)))
        for start in range(0, max(1, len(raw)), SLICE):
            part = raw[start : start + SLICE]
            data.append(part)
            sizes.extend(min(PASSAGE, len(part) - i) for i in range(0, max(1, len(part)), PASSAGE))
            held += len(part)
            if held >= SLICE:
                flush()
    flush()
    return (np.concatenate(out) if out else np.zeros((0, FEATURES), np.float32)), np.array(numbers, np.int64)


class Model:
    """Parameters by name, and the mean and spread of the features."""

    def __init__(self, mean, spread, params: dict):
        self.mean, self.spread, self.params = mean, spread, params

    @classmethod
    def fresh(cls, x, seed: int = 7) -> Model:
        import numpy as np

        rng = np.random.default_rng(seed)
        shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
        params = {k: rng.normal(0, s[0] ** -0.5, s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}
        return cls(x.mean(axis=0), x.std(axis=0) + 1e-3, params)

    def forward(self, x, numbers):
        """Scores of documents, and what the backward pass needs."""
        import numpy as np

        p = self.params
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        starts = np.concatenate([[0], np.cumsum(numbers)[:-1]])
        doc = np.repeat(np.arange(len(numbers)), numbers)
        a = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        a /= np.add.reduceat(a, starts)[doc]
        m = np.add.reduceat(h * a[:, None], starts)
        score = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"], -30, 30)))
        return score, (z, h, t, g, a, m, doc, starts)

    def gradients(self, x, numbers, y) -> dict:
        """Of the mean cross-entropy."""
        import numpy as np

        p = self.params
        score, (z, h, t, g, a, m, doc, starts) = self.forward(x, numbers)
        ds = (score - y) / len(y)
        dm = ds[:, None] * p["c"]
        da = (h * dm[doc]).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, starts)[doc])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = a[:, None] * dm[doc] + dt @ p["V"].T + dg @ p["U"].T
        dz = dh * (1 - h * h)
        return {"W": z.T @ dz, "b": dz.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": m.T @ ds, "d": ds.sum(keepdims=True)}


def fitted(x, numbers, y, seed: int = 7) -> Model:
    """A model for bags of passages x (numbers of them per document) with labels y, by Adam."""
    import numpy as np

    model, rng = Model.fresh(x, seed), np.random.default_rng(seed)
    starts = np.concatenate([[0], np.cumsum(numbers)[:-1]])
    first = {k: np.zeros_like(v) for k, v in model.params.items()}
    second = {k: np.zeros_like(v) for k, v in model.params.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BATCH):
            docs = order[i : i + BATCH]
            rows = np.concatenate([np.arange(starts[d], starts[d] + numbers[d]) for d in docs])
            step += 1
            for k, g in model.gradients(x[rows], numbers[docs], y[docs]).items():
                g = g + DECAY * model.params[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _sample(rows: DataFrame, taught: DataFrame):
    """Features, numbers and labels of the documents that teach, in order of their ids' hashes."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                x, numbers = passages(part.column(1).to_pylist())
                ends = np.cumsum(numbers)
                made = [x[e - n : e].tobytes() for e, n in zip(ends, numbers, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(made, pa.binary())], ["h", "label", "x"])

    # Of rows with one id a single one teaches, so that at most FIT_ROWS sizes reach the driver.
    held = rows.join(F.broadcast(taught), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    held = stored(held.select(F.xxhash64("doc_id").alias("h"), "text", "label"))
    left, last = FIT_PASSAGES, None
    for r in sorted(held.select("h", F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE)).alias("n")).collect()):
        left -= r["n"]
        if left < 0:
            break
        last = r["h"]
    held = held.where(F.col("h") <= last) if last is not None else held.limit(0)
    found = sorted(map_arrow(held, run, "h long, label int, x binary").collect(), key=lambda r: (r["h"], r["x"]))
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in found]
    if not xs:
        return np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(xs).astype(float), np.array([len(v) for v in xs]), np.array([r["label"] for r in found], float)


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (of label 1), passages.

    Labels count where they are 0 or 1, the smaller one of several; rows without id are scored and teach nothing.
    Null and empty texts are one empty passage. Without labels of both kinds the score is the share of 1, or 0.5
    without labels. Other columns are ignored; repeated rows are scored alike; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rest = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4))
    taught = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.min(label).cast("int").alias("label"))
        .where(rest(F.col("doc_id")) != 2)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    x, numbers, y = _sample(rows, taught)
    model = fitted(x, numbers, y) if 0 < y.sum() < len(y) else None
    share = float(y.mean()) if len(y) else 0.5
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                x, numbers = passages(part.column(1).to_pylist())
                s = model.forward(x, numbers)[0] if model else np.full(len(numbers), share)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(s, 9)), pa.array(numbers)], ["doc_id", "score", "passages"])

    held = F.coalesce(rest(F.col("doc_id")) == 2, F.lit(False))
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, passages long").select("doc_id", held.alias("held_out"), "score", "passages")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
