"""Byte-level BPE by prefix dynamic programming.

The encoding of a text's first i bytes ends in exactly one token that is
possible there, and what comes before that token is the encoding of the shorter
prefix. Storing that last token for each prefix gives the encoding of any
prefix, lets bytes be appended exactly, and limits what an edit changes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import arrow_map, table

#: Distinct pieces, prefixes and pairs of tokens that a Python worker remembers.
PIECES, PREFIXES, PAIRS = 500_000, 500_000, 1_000_000
#: Bytes up to which a piece looks its prefixes up among those of all pieces; longer ones are read from the front.
SHORT = 64
_NEVER = 1 << 62


class Vocabulary:
    """Ranks of byte strings; a rank is also the token's id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        lengths: dict[int, set[int]] = {}
        for b in ranks:
            lengths.setdefault(b[-1], set()).add(len(b))
        #: Lengths of the tokens that end in a byte, longest first.
        self.lengths = {b: sorted(n, reverse=True) for b, n in lengths.items()}
        self._last: dict[bytes, int] = {}
        ends: dict[bytes, set[int]] = {}
        for b in ranks:
            if len(b) > 1:
                ends.setdefault(b[-2:], {1}).add(len(b))
        #: Lengths of the tokens that may end in two bytes, longest first.
        self._ends = {b: sorted(n, reverse=True) for b, n in ends.items()}
        self._formed: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def formed(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self._formed:
            parts = [bytes([b]) for b in self.bytes[token]]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda k: (self.ranks.get(parts[k] + parts[k + 1], _NEVER), k))
                if self.ranks.get(parts[best] + parts[best + 1], _NEVER) >= token:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self._formed[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._formed[token]

    def reachable(self, token: int) -> bool:
        """Whether merging the token's bytes ends in the token itself."""
        return len(self.bytes[token]) == 1 or self.formed(token) is not None

    def adjacent(self, left: int, right: int) -> bool:
        """Whether merges leave these two tokens side by side.

        Run time backwards from the end: of the two, the one merged later is
        taken apart, until both are single bytes. The boundary held if no pair
        that ever met at it would have merged before the next of the two did.
        Equal ranks merge from the left.
        """
        key = (left, right)
        if key in self._pairs:
            return self._pairs[key]
        a, b, limit, held = left, right, _NEVER, self.reachable(right)
        while held:
            if self.ranks.get(self.bytes[a] + self.bytes[b], _NEVER) < limit:
                held = False
                break
            made_a, made_b = self.formed(a), self.formed(b)
            if made_a is None and made_b is None:
                break
            if made_b is None or (made_a is not None and a > b):
                limit, a = a, made_a[1]
            else:
                limit, b = b + 1, made_b[0]
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        self._pairs[key] = held
        return held


    def last(self, prefix: bytes) -> int:
        """The last token of the encoding of a short prefix, which is the same in whatever stands behind it."""
        token = self._last.get(prefix)
        if token is None:
            size, ranks = len(prefix), self.ranks
            for n in self._ends.get(prefix[-2:], (1,)):
                if n > size or (token := ranks.get(prefix[size - n :])) is None:
                    continue
                if n == size:
                    if self.reachable(token):
                        break
                    continue
                before = self.last(prefix[: size - n])
                held = self._pairs.get((before, token))
                if self.adjacent(before, token) if held is None else held:
                    break
            else:
                raise ValueError("a byte is not in the vocabulary")
            self._last[prefix] = token
        return token

    def encode_short(self, data: bytes) -> list[int]:
        out = []
        while data:
            token = self.last(data)
            out.append(token)
            data = data[: -len(self.bytes[token])]
        if len(self._last) >= PREFIXES:
            self._last.clear()
        return out[::-1]


class Prefixes:
    """Bytes, and for each of their prefixes the last token of its encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; what is stored for shorter prefixes stays."""
        self.data += data
        self._read(len(self.data))

    def _read(self, to: int) -> None:
        """Find the last tokens of the prefixes up to this length."""
        v, last, whole = self.vocabulary, self.last, self.data
        ranks, adjacent, pairs, lengths = v.ranks, v.adjacent, v._pairs.get, v.lengths
        for end in range(len(last), to + 1):
            for n in lengths.get(whole[end - 1], ()):
                start = end - n
                if start < 0 or (token := ranks.get(whole[start:end])) is None:
                    continue
                if start:
                    held = pairs((last[start], token))
                    held = adjacent(last[start], token) if held is None else held
                else:
                    held = v.reachable(token)
                if held:
                    last.append(token)
                    break
            else:
                raise ValueError("a byte is not in the vocabulary")

    def edit(self, start: int, end: int, data: bytes) -> None:
        """Replace bytes; prefixes before the edit keep their tokens, and so do those after it once two in a row
        as long as the longest token agree with the old ones."""
        old_last, old_tail = self.last, self.data[end:]
        self.data, self.last = self.data[:start] + data + old_tail, self.last[: start + 1]
        behind = start + len(data)
        self._read(behind)
        agreed, v, shift = 0, self.vocabulary, end - behind
        for at in range(behind + 1, len(self.data) + 1):
            if agreed >= v.longest:
                self.last += old_last[at + shift :]
                return
            self._read(at)
            inside = len(v.bytes[self.last[at]]) <= at - behind
            agreed = agreed + 1 if inside and self.last[at] == old_last[at + shift] else 0

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        end, out = len(self.data) if end is None else end, []
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


class Encoder:
    """Encodes texts piece by piece, as a pattern cuts them, and remembers pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.known: dict[str, tuple[list[int], str]] = {}

    def piece(self, piece: str) -> tuple[list[int], str]:
        data = piece.encode("utf-8")
        whole = self.vocabulary.ranks.get(data)
        if whole is not None:
            ids = [whole]
        elif len(data) <= SHORT:
            ids = self.vocabulary.encode_short(data)
        else:
            ids = Prefixes(self.vocabulary, data).tokens()
        out = (ids, " ".join(map(str, ids)))
        if len(data) <= SHORT:  # longer ones hardly return, and would fill the memory
            if len(self.known) >= PIECES:
                self.known.clear()
            self.known[piece] = out
        return out

    def encode(self, text: str) -> list[int]:
        known, piece = self.known.get, self.piece
        return [i for p in self.find(text) for i in (known(p) or piece(p))[0]]

    def encode_spelled(self, text: str) -> tuple[list[int], str]:
        """Ids, and the same in decimal, joined by spaces."""
        known, piece = self.known.get, self.piece
        found = [known(p) or piece(p) for p in self.find(text)]
        return list(chain.from_iterable([ids for ids, _ in found])), " ".join([s for _, s in found])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    return Encoder(Vocabulary.load(path), pattern)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Columns of docs, plus ids (array of int). Null texts count as empty: no ids. A column named ids is replaced.

    Texts of any length are encoded whole; rows are judged alone, repeated ones too; an empty table stays empty.
    """
    docs = docs.select(*[c for c in docs.columns if c != "ids"])
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*columns, "ids"])

    return arrow_map(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Columns of encoded, plus decoded (the bytes of ids). Null ids give null; a column named decoded is replaced."""
    encoded = encoded.select(*[c for c in encoded.columns if c != "decoded"])
    columns = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            data = [None if ids is None else own.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*columns, "decoded"])

    return arrow_map(encoded, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields) + ", decoded binary")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            n, spelled, back = [], [], []
            for text in batch.column("text").to_pylist():
                ids, decimal = own.encode_spelled(text or "")
                n.append(len(ids))
                spelled.append(hashlib.sha256(decimal.encode()).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spelled), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of all documents. Null texts count as empty; repeated rows each stay; long texts are encoded whole; no rows give none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return arrow_map(docs, _digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
