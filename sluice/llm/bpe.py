r"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut in halves down to leaves; every leaf is encoded on its own and
neighbours are joined up the tree. Joining is associative, so the result does
not depend on where the cuts fall:

* **Pieces** (the matches of the split pattern). The pattern only looks ahead,
  so a scan is decided by where it stands: a piece of the left side stays if
  everything it looked at lies inside the left side, and the right side's
  pieces stay from the first place where a scan started in the left side's
  undecided rest meets one of their starts. The window between grows until
  the two scans meet.
* **Tokens** of one long piece. A token sequence is the encoding of its bytes
  if and only if every adjacent pair of tokens re-encodes to itself, so the
  join re-encodes a window around the seam and widens it until the pairs on
  both rims are stable.

Decoding concatenates the tokens' bytes up the same tree.

The vocabulary file is read inside each task from ``path`` (a folder every
executor has, like the installed tokenizer files); nothing is trained."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a leaf of the text tree, and bytes of a leaf of a long piece's tree.
LEAF_CHARS = 16384
LEAF_BYTES = 1024
#: Encoded pieces of up to this many characters are remembered, so many per worker; the memory is emptied when full.
MEMO_CHARS, MEMO_PIECES = 48, 500_000
#: Characters that the split pattern may look at past a piece's start, at least (its longest contraction).
_LOOK = 3

RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                       T.StructField("decoded_sha256", T.StringType())])


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (one ``base64 rank`` pair a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder over one rank table and split pattern. Ranks are
    both merge priorities and token ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.scan = regex.compile(pattern)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.stable: dict[tuple[int, int], bool] = {}

    # --- tokens of one piece ------------------------------------------------
    def merge(self, data: bytes) -> list[int]:
        """Byte pair merges of a byte string, lowest rank first (leftmost on
        ties). A heap keeps the order, so a long string costs n log n."""
        ranks, n = self.ranks, len(data)
        if n < 2:
            return [ranks[data]] if data else []
        end = list(range(1, n + 1))  # where the part that starts here ends; 0: merged away
        prev = list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = end[i]
            if not j or j >= n or ranks.get(data[i:end[j]]) != r:
                continue  # a part of this pair has changed since
            k = end[i] = end[j]
            end[j] = 0
            if k < n:
                prev[k] = i
                if (r := ranks.get(data[i:end[k]])) is not None:
                    heappush(heap, (r, i))
            h = prev[i]
            if h >= 0 and (r := ranks.get(data[h:k])) is not None:
                heappush(heap, (r, h))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = end[i]
        return out

    def pair_stable(self, a: int, b: int) -> bool:
        """True if tokens ``a b`` are what their joined bytes encode to."""
        key = (a, b)
        got = self.stable.get(key)
        if got is None:
            if len(self.stable) >= MEMO_PIECES:
                self.stable.clear()
            got = self.stable[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenated bytes of two encodings."""
        if not left or not right:
            return left + right
        if self.pair_stable(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            data = b"".join(map(self.bytes_of.__getitem__, left[i:])) + b"".join(map(self.bytes_of.__getitem__, right[:j]))
            mid = self.merge(data)
            if (i == 0 or self.pair_stable(left[i - 1], mid[0])) and \
                    (j == len(right) or self.pair_stable(mid[-1], right[j])):
                return left[:i] + mid + right[j:]
            k *= 2

    def piece_tree(self, data: bytes) -> list[int]:
        """Tokens of a piece: halves, encoded and joined."""
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        h = len(data) // 2
        return self.join_tokens(self.piece_tree(data[:h]), self.piece_tree(data[h:]))

    def piece(self, text: str) -> tuple[int, ...]:
        got = self.memo.get(text)
        if got is None:
            data = text.encode("utf-8")
            whole = self.ranks.get(data)
            got = (whole,) if whole is not None else tuple(self.piece_tree(data))
            if len(text) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_PIECES:
                    self.memo.clear()
                self.memo[text] = got
        return got

    # --- pieces of a text ---------------------------------------------------
    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        """Pieces of the concatenation of two split texts (both lists cover
        their text without gaps)."""
        if not left or not right:
            return left + right
        # undecided rest of the left side: pieces whose match looked at its end
        cut, rest = len(left), 0
        while cut:
            n = len(left[cut - 1])
            if rest >= 1 and rest + n >= _LOOK:  # a character follows, and the longest look-ahead fits
                break
            cut, rest = cut - 1, rest + n
        tail = "".join(left[cut:])
        grow = 4
        while True:
            window = tail + "".join(right[:grow])
            ends, at = {len(tail)}, len(tail)
            for p in right[:grow]:
                at += len(p)
                ends.add(at)
            whole = grow >= len(right)
            out, pos = [], 0
            for m in self.scan.finditer(window):
                # the scan may stop where it stands on a start of the right side's own pieces
                if m.start() >= len(tail) and m.start() in ends:
                    pos = m.start()
                    break
                out.append(m.group())
                pos = m.end()
                if not whole and (pos >= len(window) or m.start() + _LOOK > len(window)):
                    pos = -1  # looked at the window's end: widen it
                    break
            if pos >= 0 and (whole or pos < len(window)):
                keep, at = 0, len(tail)
                while at < pos:
                    at += len(right[keep])
                    keep += 1
                del left[cut:]
                left += out
                left += right[keep:]
                return left
            grow *= 4

    def pieces(self, text: str, leaf: int = LEAF_CHARS) -> list[str]:
        if len(text) <= leaf:
            return self.scan.findall(text)
        h = len(text) // 2
        return self.join_pieces(self.pieces(text[:h], leaf), self.pieces(text[h:], leaf))

    def encode(self, text: str, leaf: int = LEAF_CHARS) -> array:
        """Token ids of a text, as an array of unsigned 32-bit integers."""
        memo, piece = self.memo.get, self.piece
        return array("I", list(chain.from_iterable([memo(p) or piece(p) for p in self.pieces(text, leaf)])))

    def decode(self, ids, leaf: int = LEAF_CHARS) -> bytes:
        """Bytes of token ids: concatenated up the tree."""
        if len(ids) <= leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        h = len(ids) // 2
        return self.decode(ids[:h], leaf) + self.decode(ids[h:], leaf)


#: Codecs of this process by (path, pattern): a reused worker keeps its memory between tasks.
CODECS: dict[tuple[str, str], Codec] = {}


def worker_codec(path: str, pattern: str) -> Codec:
    """The codec of this Python worker. Functions reach executors by value, so
    the module's own table is looked up by name; where the package is not
    importable there, each task makes its own."""
    import importlib
    try:
        kept = importlib.import_module("sluice.llm.bpe").CODECS
    except ImportError:
        kept = {}
    codec = kept.get((path, pattern))
    if codec is None:
        codec = kept[(path, pattern)] = Codec(load_ranks(path), pattern)
    return codec


def _little_endian(ids: array) -> bytes:
    import sys
    if sys.byteorder == "big":  # pragma: no cover
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """Token ids (array of bigint) of a text column; null encodes as the empty text."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = worker_codec(path, pattern)
        for s in batches:
            yield pd.Series([codec.encode(t or "").tolist() for t in s])
    return run.asNondeterministic()(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """Bytes (binary) that token ids stand for; null decodes to no bytes."""
    @F.pandas_udf(T.BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = worker_codec(path, pattern)
        for s in batches:
            yield pd.Series([codec.decode([] if v is None else [int(i) for i in v]) for v in s])
    return run.asNondeterministic()(ids)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_tokens, ids_sha256,
    decoded_sha256`` after a round trip through ids.

    A null text counts as the empty text (no tokens, digests of no bytes).
    Repeated rows stay repeated. One narrow pass: no shuffle, each text is
    handled in the task that read it, memory is bounded by a batch."""
    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = worker_codec(path, pattern)
        for s in batches:
            rows = []
            for t in s:
                ids = codec.encode(t or "")
                rows.append((len(ids), hashlib.sha256(_little_endian(ids)).hexdigest(),
                             hashlib.sha256(codec.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
    out = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return out.select(F.col(id_col), run.asNondeterministic()("_text").alias("_r")).select(id_col, "_r.*")
