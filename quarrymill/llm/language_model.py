"""Language-model scores from a log-frequency Bloom filter.

An n-gram of count c has the level 1 + floor(log2(c / least)), where least is the smallest count held for its
order. The filter holds the pairs (n-gram, 1), ..., (n-gram, level); a count is read by probing levels until one is
missing. Unigrams are held from a count of 1 on, bigrams from 2 on, at every size of the corpus: a bigram that
occurs once tells no more of other texts than one that never does.

The filter grows with the n-grams, so it is not broadcast whole: it lies in segments, one for each block of n-grams
by hash, and the number of blocks follows the bytes of the corpus. Documents are cut into chunks of about CHUNK
tokens. Each chunk sends its distinct n-grams, with their counts in training texts, to the blocks; a block sums the
counts, builds its segment, probes it for every n-gram asked and sends levels back to the chunks. The held mass of
each history, the sum of what its bigrams' levels stand for, takes a second and smaller round of the same kind.

p(w | h) = SEEN * c(hw) / H(h) + (1 - SEEN * S(h) / H(h)) * p(w), with counts c as levels stand for them, S(h) the
held mass of h and H(h) the larger of c(h) and S(h); p(w) = (c(w) + ADD) / (M + ADD * (V + 1)), M the sum of c over
the V words. For every history these sum to 1 over all words and one unknown word, but for false hits of the
filter (one in 2**PROBES). The base score uses the exact counts, which a block has before it makes levels of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarrymill.llm.common import discarded, map_arrow, mixed, stored, table

END = "\n"  # no word holds white space
#: The hash of what stands before the first token of a text. Not a word: it counts neither in N nor in V. As the least
#: hash of block 0 it has the first place in every chunk's list of words.
START = 1
SEED = 42
#: The least count held of each order.
LEAST = {1: 1, 2: 2}
PROBES = 20
CHUNK = 800_000
BLOCK_BYTES = 6_000_000
SEEN = 0.6
ADD = 0.1
MEMO = 120_000
ROWS = 128
_MASK = (1 << 64) - 1
_LOW = 40
_OWNER = 128
#: Orders of rows: a document, the tokens of a chunk, unigrams, bigrams; what histories hold, levels of a chunk's bigrams.
DOCUMENT, TEXT, WORD, PAIR, COUNT, MASS, LEVEL = range(-1, 6)
_NAMES = ["chunk", "block", "order", "keys", "counts", "row", "doc_id", "held_out"]


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; the end is not among them."""
    return (text or "").encode().lower().split()


class Hashes(dict):
    """Hashes of words, memoised; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        x = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return x


def shifted(values, starts, first):
    """What stands before each token: first at the start of a text."""
    import numpy as np

    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[starts] = first
    return before


def pair_keys(hashes, starts, blocks: int):
    """Keys of the bigrams of texts, from START over the words to the end: the block, then _LOW bits within it."""
    import numpy as np

    keys = mixed(mixed(shifted(hashes, starts, np.uint64(START))) + hashes)
    return ((keys >> np.uint64(_LOW)) % np.uint64(blocks)) << np.uint64(_LOW) | keys & np.uint64((1 << _LOW) - 1)


def _block_of(hashes, blocks: int):
    import numpy as np

    return ((hashes >> np.uint64(_LOW)) % np.uint64(blocks)).astype(np.int64)


def _cut(block) -> Iterator[tuple[int, int, int]]:
    """(block, start, end) of each run of an ascending array."""
    import numpy as np

    starts = np.concatenate([[0], np.nonzero(block[1:] != block[:-1])[0] + 1]) if len(block) else np.zeros(0, np.int64)
    return zip(block[starts].tolist(), starts.tolist(), np.append(starts[1:], len(block)).tolist())


def packed(numbers) -> bytes:
    """Non-negative integers as compressed planes of bytes, the lowest first."""
    import numpy as np

    x = np.ascontiguousarray(numbers, "<u8")
    planes = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes(), 1)


def unpacked(data: bytes):
    """The integers of packed, as unsigned 64-bit."""
    import numpy as np

    flat = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, : data[0]] = flat.T
    return out.view("<u8").ravel()


def _ranks(often):
    """Places by falling frequency, so that frequent words have small numbers."""
    import numpy as np

    ranks = np.empty(len(often), np.int64)
    ranks[np.argsort(-often.astype(np.int64), kind="stable")] = np.arange(len(often))
    return ranks


def _read(text: bytes, counts: bytes, n_words: int):
    """(place of each token's word in the chunk's list, number of tokens of each document) of a row of order TEXT."""
    import numpy as np

    both = unpacked(counts).astype(np.int64)
    return np.argsort(-both[:n_words], kind="stable")[unpacked(text).astype(np.int64)], both[n_words:]


def _levels(counts, least: int):
    import numpy as np

    return np.where(counts >= least, 1 + np.floor(np.log2(np.maximum(counts, least) / least)).astype(np.int64), 0)


def meant(levels, least: int):
    """The counts that levels stand for, 0 for no level: whole numbers, so that sums don't depend on their order."""
    import numpy as np

    low = np.where(levels > 0, least << np.maximum(levels.astype(np.int64) - 1, 0), 0)
    return np.where(low > 2, low * 7 // 5, low)


class Filter:
    """A segment of a log-frequency Bloom filter, for keys and their counts."""

    def __init__(self, keys, counts, least: int):
        import numpy as np

        levels = _levels(counts, least)
        self.bits = max(1 << 16, int(levels.sum() * PROBES * 1.45))
        flags = np.zeros(self.bits, np.uint8)
        for level in range(1, int(levels.max(initial=0)) + 1):
            start, step = self._start(keys[levels >= level], level)
            for i in range(PROBES):
                flags[self._bit(start, step, i)] = 1
        self.data = np.packbits(flags, bitorder="little")

    def _start(self, keys, level: int):
        """Where the probes of (key, level) start, and their step."""
        import numpy as np

        first = mixed(keys + np.uint64(level * 0x9E3779B97F4A7C15 & _MASK))
        return first & np.uint64(0xFFFFFFFF), (first >> np.uint64(32)) | np.uint64(1)

    def _bit(self, start, step, i: int):
        import numpy as np

        return ((start + np.uint64(i) * step + np.uint64(i * i * i)) % np.uint64(self.bits)).astype(np.int64)

    def levels(self, keys):
        """Each key's level, 0 for absent keys. Only what passed a probe gets the next one."""
        import numpy as np

        out = np.zeros(len(keys), np.uint8)
        at, level = np.arange(len(keys)), 0
        while len(at):
            level += 1
            start, step = self._start(keys[at], level)
            for i in range(PROBES):
                bit = self._bit(start, step, i)
                held = (self.data[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                at, start, step = at[held], start[held], step[held]
            out[at] = level
        return out


def _record(rows: list[tuple], kind, names: list[str] = _NAMES):
    """A batch of rows; kind is the Arrow type of doc_id."""
    import pyarrow as pa

    types = {"chunk": pa.int64(), "block": pa.int64(), "order": pa.int32(), "row": pa.int64(), "doc_id": kind, "held_out": pa.bool_(), "keys": pa.binary(), "counts": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[n]) for i, n in enumerate(names)], names)


def _chunks(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows of each chunk: its documents' tokens as places in its list of words, its words and its bigrams by block.

    rows: doc_id, held_out, text. Words and bigrams come with their counts in texts that are not held out.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        from pyspark import TaskContext

        memo, first, chunk, row = Hashes(), TaskContext.get().partitionId() << 33, 0, 0
        docs: list[tuple] = []
        held: list = []
        size = 0

        def out(kind) -> Iterator:
            sizes = np.array([len(h) for h in held])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            flat = np.concatenate(held)
            train = np.array([not d[2] for d in docs])
            counted = np.repeat(train, sizes)
            words, at = np.unique(np.append(flat, np.uint64(START)), return_inverse=True)
            by = np.lexsort((words, _block_of(words, blocks)))
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            words, at = words[by], place[at]
            counts = np.bincount(at[:-1], counted, len(words)).astype(np.int64)
            counts[at[-1]] = train.sum()
            id_ = first + chunk
            for start in range(0, len(docs), 5000):
                yield _record([(id_, None, DOCUMENT, None, None, *d) for d in docs[start : start + 5000]], kind)
            often = np.bincount(at[:-1], minlength=len(words))
            made = [(id_, None, TEXT, packed(_ranks(often)[at[:-1]]), packed(np.concatenate([often, sizes])), None, None, None)]
            made += [(id_, b, WORD, words[s:e].tobytes(), packed(counts[s:e]), None, None, None) for b, s, e in _cut(_block_of(words, blocks))]
            pairs, at = np.unique(pair_keys(flat, starts, blocks), return_inverse=True)
            counts = np.bincount(at, counted, len(pairs)).astype(np.int64)
            low = pairs & np.uint64((1 << _LOW) - 1)
            made += [(id_, b, PAIR, packed(np.diff(low[s:e], prepend=np.uint64(0))), packed(counts[s:e]), None, None, None) for b, s, e in _cut((pairs >> np.uint64(_LOW)).astype(np.int64))]
            for start in range(0, len(made), 256):
                yield _record(made[start : start + 256], kind)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for start in range(0, batch.num_rows, ROWS):
                for doc_id, out_of, text in zip(*(c.to_pylist() for c in batch.slice(start, ROWS).columns), strict=True):
                    flat = [*tokens(text), END.encode()]
                    held.append(np.fromiter(map(memo.__getitem__, flat), np.uint64, len(flat)))
                    docs.append((first + row, doc_id, out_of))
                    size, row = size + len(flat), row + 1
                    if size >= CHUNK:
                        yield from out(kind)
                        chunk, size = chunk + 1, 0
                        docs.clear()
                        held.clear()
        if docs:
            yield from out(kind)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows.select("doc_id", "held_out", "text"), run, f"chunk long, block long, order int, keys binary, counts binary, row long, doc_id {kind}, held_out boolean")


def _grouped(batches: Iterator, by: tuple[int, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal values at the positions by; batches come sorted."""
    now, held = None, []
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            for values in zip(*(c.to_pylist() for c in batch.slice(start, ROWS).columns), strict=True):
                key = tuple(values[i] for i in by)
                if key != now:
                    if held:
                        yield now, held
                    now, held = key, []
                held.append(values)
    if held:
        yield now, held


def _answered(asked: DataFrame) -> DataFrame:
    """chunk, block, order, data, and exact counts for words; rows with chunk -1 hold sums: N, V, M of the block.

    A block's n-grams are summed by one task: their number is bounded, as the number of blocks follows the corpus.
    The first chunk that asks for a held bigram owns it (a bit of the answer), so that it is added up once.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for (block, order), rows in _grouped(batches, (0, 1)):
            if order == WORD:
                parts = [np.frombuffer(r[3], np.uint64) for r in rows]
            else:
                parts = [np.cumsum(unpacked(r[3]), dtype=np.uint64) for r in rows]
            counts = np.concatenate([unpacked(r[4]) for r in rows]).astype(float)
            keys, first, at = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
            counts = np.bincount(at, counts, len(keys)).astype(np.int64)
            levels = Filter(keys[counts >= LEAST[order]], counts[counts >= LEAST[order]], LEAST[order]).levels(keys)
            answers = levels[at]
            if order == PAIR:
                answers[first[counts >= LEAST[order]]] |= _OWNER
            ends = np.cumsum([len(p) for p in parts])
            own = keys != START if order == WORD else np.ones(len(keys), bool)
            sums = [int(counts[own].sum()), int((counts[own] > 0).sum()), int(meant(levels[own & (counts > 0)], LEAST[order]).sum())]
            out = [(-1, block, order, None, None, *sums)]
            for r, e, p in zip(rows, ends, parts, strict=True):
                out.append((r[2], block, order, packed(answers[e - len(p) : e]), packed(counts[at[e - len(p) : e]]) if order == WORD else None, None, None, None))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for start in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out[start : start + 512]], t) for i, t in enumerate(types)], ["chunk", "block", "order", "keys", "counts", "n", "v", "m"])

    placed = asked.select("block", "order", "chunk", "keys", "counts").repartition("block", "order").sortWithinPartitions("block", "order", "chunk")
    return map_arrow(placed, run, "chunk long, block long, order int, keys binary, counts binary, n long, v long, m long")


def _by_chunk(rows: DataFrame) -> DataFrame:
    return rows.repartition("chunk").sortWithinPartitions("chunk", "order", "block", "row")


def _histories(rows: DataFrame, blocks: int) -> DataFrame:
    """For each chunk: the level of the bigram at each token (order LEVEL), and by block the held mass of its words as histories that the chunk owns (order MASS). rows: tokens, words, answers for both (those for words as COUNT)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for (chunk,), held in _grouped(batches, (0,)):
            words = np.concatenate([np.frombuffer(r[3], np.uint64) for r in held if r[2] == WORD])
            at, sizes = next(_read(r[3], r[4], len(words)) for r in held if r[2] == TEXT)
            exact = np.concatenate([unpacked(r[4]) for r in held if r[2] == COUNT])
            answers = np.concatenate([unpacked(r[3]) for r in held if r[2] == PAIR]).astype(np.uint8)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            history = shifted(at, starts, 0)
            _, first, which = np.unique(pair_keys(words[at], starts, blocks), return_index=True, return_inverse=True)
            owned = answers >= _OWNER
            mass = np.bincount(history[first[owned]], meant(answers[owned] & (_OWNER - 1), LEAST[PAIR]), len(words)).astype(np.int64)
            levels = (answers & (_OWNER - 1))[which]
            out = [(chunk, None, LEVEL, None, packed(levels), None)]
            words, mass = words[exact >= LEAST[PAIR]], mass[exact >= LEAST[PAIR]]  # of others no bigram is held
            out += [(chunk, b, MASS, words[s:e].tobytes(), packed(mass[s:e]), None) for b, s, e in _cut(_block_of(words, blocks))]
            for start in range(0, len(out), 256):
                yield _record(out[start : start + 256], None, _NAMES[:6])

    return map_arrow(_by_chunk(rows.select("chunk", "block", "order", "keys", "counts", "row")), run, "chunk long, block long, order int, keys binary, counts binary, row long")


def _masses(asked: DataFrame) -> DataFrame:
    """chunk, block, order, counts: the held mass of each word asked for, summed over the chunks."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for (block,), rows in _grouped(batches, (0,)):
            parts = [np.frombuffer(r[2], np.uint64) for r in rows]
            keys, at = np.unique(np.concatenate(parts), return_inverse=True)
            total = np.bincount(at, np.concatenate([unpacked(r[3]) for r in rows]).astype(float), len(keys)).astype(np.int64)[at]
            ends = np.cumsum([len(p) for p in parts])
            out = [(r[1], block, MASS, packed(total[e - len(p) : e])) for r, e, p in zip(rows, ends, parts, strict=True)]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            for start in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out[start : start + 512]], t) for i, t in enumerate(types)], ["chunk", "block", "order", "counts"])

    placed = asked.select("block", "chunk", "keys", "counts").repartition("block").sortWithinPartitions("block", "chunk")
    return map_arrow(placed, run, "chunk long, block long, order int, counts binary")


def probabilities(word, history, pair, mass, m: int, v: int):
    """p(w | h) for counts as levels stand for them: of the word, the history and the pair, and the history's held mass."""
    import numpy as np

    whole = np.maximum(np.maximum(history, mass), 1)
    return SEEN * pair / whole + (1 - SEEN * mass / whole) * (word + ADD) / (m + ADD * (v + 1))


def _scores(rows: DataFrame, n: int, v: int, m: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score. rows: documents, tokens, levels, answers for words, masses."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        types = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for _, held in _grouped(batches, (0,)):
            docs, parts = [], {WORD: [], MASS: [], LEVEL: []}
            for _, _, order, keys, counts, _, doc_id, out_of in held:
                if order == DOCUMENT:
                    docs.append((doc_id, out_of))
                elif order == TEXT:
                    text = keys, counts
                else:
                    parts[order].append((keys, counts))
            exact, mass, pairs = (np.concatenate([np.zeros(0, np.uint64), *(unpacked(c) for _, c in parts[order])]).astype(np.int64) for order in (WORD, MASS, LEVEL))
            at, sizes = _read(*text, len(exact))
            held_mass = np.zeros(len(exact), np.int64)
            held_mass[exact >= LEAST[PAIR]] = mass
            one = meant(np.concatenate([unpacked(k) for k, _ in parts[WORD]]), LEAST[WORD])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            history = shifted(at, starts, 0)
            p = probabilities(one[at], one[history], meant(pairs, LEAST[PAIR]), held_mass[history], m, v)
            base = np.log10((exact + ADD) / (n + ADD * (v + 1)))
            sums = [np.add.reduceat(x, starts).tolist() for x in ((exact > 0)[at].astype(np.int64), base[at], np.log10(p))]
            out = [(*d, *rest) for d, *rest in zip(docs, sizes.tolist(), *sums, strict=True)]
            for start in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out[start : start + 1000]], t) for i, t in enumerate(types)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(_by_chunk(rows.select(*_NAMES)), run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def scored(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: a boolean column of docs; rows where it is not true train. Null and empty texts are an end alone.
    Null ids and repeated rows are scored, and train, as rows of their own. Without training tokens probabilities
    are those of the additive smoothing. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count(F.lit(1))).first()[0]
    blocks = max(64, -(-size // BLOCK_BYTES))
    made = stored(_chunks(rows, blocks), ("order",))
    documents, texts, words, pairs = (made.where(F.col("order") == o).select(*_NAMES) for o in (DOCUMENT, TEXT, WORD, PAIR))
    answers = stored(_answered(words.union(pairs)))
    sums = {r["order"]: r for r in answers.where("chunk < 0").groupBy("order").agg(*(F.sum(c).alias(c) for c in "nvm")).collect()}
    n, v, m = (sums[WORD][c] for c in "nvm") if WORD in sums else (0, 0, 0)
    discarded(made, f"order={PAIR}")
    answers = answers.where("chunk >= 0").select("chunk", "block", "order", "keys", "counts", F.lit(None).cast("long").alias("row"))
    counts = answers.withColumn("order", F.when(F.col("order") == WORD, COUNT).otherwise(F.col("order")))
    known = stored(_histories(texts.union(words).select(*_NAMES[:6]).union(counts), blocks), ("order",))
    masses = _masses(known.where(F.col("order") == MASS)).select("chunk", "block", "order", F.lit(None).cast("binary").alias("keys"), "counts", F.lit(None).cast("long").alias("row"))
    levels = known.where(F.col("order") == LEVEL).select(*_NAMES[:6])
    rest = levels.union(answers.where(F.col("order") == WORD)).union(masses)
    found = _scores(documents.union(texts).unionByName(rest, allowMissingColumns=True), n, v, m)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    return scored(table(spark, sf_dir, "documents"), held)
