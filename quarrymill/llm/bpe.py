"""Byte-level BPE by rank, exactly as the merges would have it, in time linear in the text.

The bytes of a piece are read as Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds
the longest token at each byte in one pass. From the left the encoder takes the longest token that may stand next
to the one before; where none fits it goes back and takes the next shorter one. Two tokens may be neighbours if,
undoing their merges from the latest on, no pair across their border would have been merged first; answers are
memoised. Texts equal to what merging by rank gives have exactly one such sequence, so no ranks are compared over
the whole piece. A position that led nowhere is not tried again, which keeps the time linear.

Ids travel as binary: little-endian unsigned 32-bit integers, the form of token shards on disk.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrymill.llm.common import map_arrow, table

BYTE = 256
#: Rows that are Python objects at one time; entries of a worker's memos before they start anew.
ROWS, CHUNKS, PAIRS = 128, 250_000, 400_000
_NEVER = 1 << 62


class Vocabulary:
    """Tokens by rank, the merge that makes each, and the automaton. Built once in a process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.shorter = [next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), -1) for t in self.tokens]
        self.halves: list[tuple[int, int] | None] = [None] * len(self.tokens)
        self.merged: dict[tuple[int, int], int] = {}
        self.sizes = [len(t) for t in self.tokens]
        self.may_meet: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        for rank, token in enumerate(self.tokens):
            left = self.shorter[rank] if token else -1
            while left >= 0:
                right = ranks.get(token[len(self.tokens[left]) :], _NEVER)
                if left < rank and right < rank and self._meet(left, right):
                    self.halves[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
                left = self.shorter[left]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()

    @classmethod
    def read(cls, file: bytes, pattern: str) -> Vocabulary:
        """From the lines of a rank file: a token in base64 and its rank."""
        return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}, pattern)

    def _meet(self, left: int, right: int) -> bool:
        """Whether merging leaves these tokens side by side: no pair over their border is due before what it breaks."""
        due = _NEVER
        while True:
            if self.merged.get((left, right), _NEVER) < due:
                return False
            l_parts, r_parts = self.halves[left], self.halves[right]
            if l_parts is None and r_parts is None:
                return True
            # The later merge is undone first. On equal ranks the left pair was merged first, and a pair over the
            # border lies left of the right token's own and so goes before it.
            if r_parts is None or l_parts is not None and left > right:
                due, left = left, l_parts[1]
            else:
                due, right = right + 1, r_parts[0]

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        sizes, shorter, memo, total, most = self.sizes, self.shorter, self.may_meet, len(piece), len(self.tokens)
        longest = [-1] * (total + 1)
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - sizes[rank]] = rank  # ends come in ascending order: the longest is last
        if len(memo) >= PAIRS:
            memo.clear()
        ids: list[int] = []
        closed = bytearray(total + 1)
        at, rank, last = 0, longest[0], -1
        while at < total:
            while rank >= 0:
                end = at + sizes[rank]
                if not closed[end]:
                    if last < 0:
                        break
                    pair = last * most + rank
                    meet = memo.get(pair)
                    if meet is None:
                        meet = memo[pair] = self._meet(last, rank)
                    if meet:
                        break
                rank = shorter[rank]
            if rank >= 0:
                ids.append(rank)
                last, at, rank = rank, end, longest[end]
            else:
                closed[at] = 1
                if not ids:
                    raise ValueError("the vocabulary lacks single bytes")
                rank = ids.pop()
                at -= sizes[rank]
                rank, last = shorter[rank], ids[-1] if ids else -1
        return ids

    def _chunk(self, chunk: str) -> bytes:
        ids = [i for piece in self.find(chunk) for i in self.piece(piece.encode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _missed(self, chunk: str) -> bytes:
        """Ids of a chunk that is not among the newer memos. A mark after a letter is a match of its own."""
        if chunk[-1] in ".,!?;:" and chunk[-2:-1].isalpha():
            word = chunk[:-1]
            ids = self.chunks.get(word)
            return (self._missed(word) if ids is None else ids) + self._mark(chunk[-1])
        ids = self.older.get(chunk)
        if ids is None:
            ids = self._chunk(chunk)
        if len(chunk) < 48:
            if len(self.chunks) >= CHUNKS:
                self.older, self.chunks = self.chunks, {}
            self.chunks[chunk] = ids
        return ids

    def _mark(self, mark: str) -> bytes:
        return struct.pack("<I", self.ranks[mark.encode()])

    def encode(self, text: str) -> bytes:
        """Ids of a text.

        A match of the pattern holds white space only where it starts or throughout, so the text may be cut before
        a space that follows another character; the parts are memoised. Patterns with other borders need find()
        over the whole text.
        """
        out = []
        parts = text.split(" ")
        chunk = parts[0]
        for part in parts[1:]:
            if chunk and not chunk[-1].isspace():
                ids = self.chunks.get(chunk)
                out.append(self._missed(chunk) if ids is None else ids)
                chunk = " " + part
            else:
                chunk += " " + part
        out.append(self._chunk(chunk))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_built: dict[tuple[int, str], Vocabulary] = {}


def _vocabulary(file: bytes, pattern: str) -> Vocabulary:
    if (key := (hash(file), pattern)) not in _built:
        _built.clear()
        _built[key] = Vocabulary.read(file, pattern)
    return _built[key]


def _mapped(df: DataFrame, source: str, steps: dict[str, str], schema: str, vocabulary: str, pattern: str) -> DataFrame:
    """The columns of df that schema has, and those of steps: out -> method of the vocabulary, the first from the column source, each other from the one before.

    All steps run in one worker, which holds one vocabulary. The file is read here and its bytes (under 1 MB for
    50,000 tokens) are broadcast.
    """
    with open(vocabulary, "rb") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in StructType.fromDDL(schema).names if c not in steps]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = _vocabulary(file.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                values, made = part.column(part.schema.get_field_index(source)).to_pylist(), []
                for what in steps.values():
                    values = [*map(getattr(words, what), values)]
                    made.append(pa.array(values, pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *made], [*kept, *steps])

    return map_arrow(df, run, schema)


def _default(vocabulary: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(doc_id, text), and the type of doc_id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def _n_tokens():
    return F.floor(F.octet_length("ids") / 4).alias("n_tokens")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id (of the type it has), ids, n_tokens.

    A null text is empty; empty texts have no ids. Null and repeated doc_ids are kept as they are; other columns
    are ignored. Strings of special tokens are ordinary text. vocabulary is the path of a rank file on the driver.
    """
    rows, kind = _texts(docs, id_col, text_col)
    made = _mapped(rows, "text", {"ids": "encode"}, f"doc_id {kind}, ids binary", *_default(vocabulary, pattern))
    return made.select("doc_id", "ids", _n_tokens())


def decode(encoded: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """encoded (doc_id, ids and others) with decoded: the bytes that the ids stand for; null ids give no bytes."""
    rows = encoded.withColumn("ids", F.coalesce("ids", F.lit(b"")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return _mapped(rows, "ids", {"decoded": "decode"}, f"{schema}, decoded binary", *_default(vocabulary, pattern))


def digests(docs: DataFrame) -> DataFrame:
    """encode() and decode() of docs in one pass, with SHA-256 of both results in place of the decoded bytes."""
    rows, kind = _texts(docs, "doc_id", "text")
    done = _mapped(rows, "text", {"ids": "encode", "decoded": "decode"}, f"doc_id {kind}, ids binary, decoded binary", *_default(None, None))
    return done.select("doc_id", _n_tokens(), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents")).drop("ids")
