"""Byte-level BPE as a monoid: encode halves, join neighbours at their boundary.

A text is cut into halves down to leaves; each leaf is encoded alone, and neighbours join up the tree. The join grows a
window from the seam on both sides until the tokens outside are certain, and encodes only the window anew:

* *Between matches of the pattern.* A place where a blank or line break follows a character that is no white space is the
  start of a match in any context: no alternative of the pattern runs from something else into white space, and the
  matcher runs left to right and never looks back. The window ends at such places (or at the ends of the node), so what
  lies outside is matched, and encoded, as in the whole text.
* *Inside one long match* (a run of letters, digits or marks). Two valid encodings side by side are the encoding of the
  joined bytes if the pair of tokens at the seam is what BPE makes of their bytes. The window doubles until both its
  edges are such pairs.

Decoding concatenates the bytes of the tokens up the same tree.

Defined cases: null texts are empty; an empty text has no tokens; rows that repeat are encoded each. A task holds a
batch of texts and the tokens of one of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lots, short_batches

#: Characters in a leaf of a text, bytes in a leaf of one long match.
LEAF, PIECE = 256, 2_048
#: A vocabulary file above this isn't broadcast.
MOST_VOCABULARY = 64 << 20
#: Runs that the pattern matches as one, whatever the version of Unicode.
_RUN = re.compile(r" ?[A-Za-z]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+")


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Codec:
    """Encoder and decoder over the ranks of a tiktoken file, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, piece: int = PIECE):
        import tiktoken

        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf, self.piece = max(2, leaf), max(2, piece)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def _pair(self, a: int, b: int) -> bool:
        return self.core._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings, all of it one match."""
        if not left or not right or self._pair(left[-1], right[0]):
            return left + right
        w = 4
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            mid = self.core._encode_single_piece(b"".join(self.bytes_of[i] for i in left[a:] + right[:b]))
            if (a == 0 or self._pair(left[a - 1], mid[0])) and (b == len(right) or self._pair(mid[-1], right[b])):
                return left[:a] + mid + right[b:]
            w *= 2

    def encode_piece(self, data: bytes) -> list[int]:
        """The tokens of one match: halves down to leaves, joined again."""
        if len(data) <= self.piece:
            return self.core._encode_single_piece(data) if data else []
        half = len(data) // 2
        return self.join_tokens(self.encode_piece(data[:half]), self.encode_piece(data[half:]))

    def _window(self, text: str) -> list[int]:
        if len(text) > self.piece and _RUN.fullmatch(text):
            return self.encode_piece(text.encode())
        return self.core.encode_ordinary(text)

    @staticmethod
    def _sure(text: str, at: int) -> bool:
        return text[at] in " \n" and not text[at - 1].isspace()

    def _node(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self._window(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = self._node(text, lo, mid), self._node(text, mid, hi)
        a, b = mid - 1, mid + 1
        while a > lo and not self._sure(text, a):
            a -= 1
        while b < hi and not self._sure(text, b):
            b += 1
        # the tokens to take away are those of the window's two parts, each as its node has seen it
        drop_left = len(self._window(text[a:mid])) if a > lo else len(left)
        drop_right = len(self._window(text[mid:b])) if b < hi else len(right)
        return left[:len(left) - drop_left] + self._window(text[a:b]) + right[drop_right:]

    def encode(self, text: str) -> list[int]:
        return self._node(text, 0, len(text)) if text else []

    def decode(self, tokens: list[int]) -> bytes:
        """Bytes of the tokens; a node's are those of its left half, then of its right half."""
        if len(tokens) <= self.leaf:
            return b"".join([self.bytes_of[i] for i in tokens])
        half = len(tokens) // 2
        return self.decode(tokens[:half]) + self.decode(tokens[half:])

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of tokens, SHA-256 of their decimal ids joined by commas, SHA-256 of the decoded bytes)."""
        tokens = self.encode(text)
        ids = ",".join([self.decimal[i] for i in tokens])
        return len(tokens), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(self.decode(tokens)).hexdigest()


def _vocabulary(spark: SparkSession, path: str):
    """The ranks for the executors: a file of fixed, checked size."""
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY + 1)
    if len(data) > MOST_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MOST_VOCABULARY} bytes isn't broadcast")
    return spark.sparkContext.broadcast(data)


def _mapped(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str, schema: str, kinds: list, row, null=""):
    shared = _vocabulary(docs.sparkSession, vocabulary)
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in lots(batches):
            codec = codec or Codec(ranks_of(shared.value), pattern)
            ids, texts = batch.columns
            out = [row(codec, t if t is not None else null) for t in texts.to_pylist()]
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids, *cols], names)

    names = [c.split()[0] for c in schema.split(", ")]
    kind = docs.schema[id_col].dataType.simpleString()
    head, rest = schema.split(", ", 1)
    return docs.select(F.col(id_col).alias(head), F.col(text_col).alias("t")).mapInArrow(run, f"{head} {kind}, {rest}")


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tokens`` of every whole text."""
    return _mapped(docs, id_col, text_col, vocabulary, pattern, "doc_id, tokens array<int>", [pa.list_(pa.int32())], lambda c, t: (c.encode(t),))


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """``doc_id, data`` (the bytes) of every row of tokens."""
    return _mapped(encoded, id_col, tokens_col, vocabulary, pattern, "doc_id, data binary", [pa.binary()], lambda c, t: (c.decode(t),), null=())


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text encoded, its tokens decoded again, and both digested."""
    return _mapped(docs, id_col, text_col, vocabulary, pattern, "doc_id, n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], lambda c, t: c.digests(t))
