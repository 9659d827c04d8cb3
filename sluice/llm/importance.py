"""Target-distribution importance resampling over an Aho-Corasick dictionary.

Features are runs of one to ``longest`` consecutive words, hashed into
``buckets`` by the CRC-32 of their bytes. A bucket gains by how much commoner it is
in the target than in the corpus; a document's weight is the sum of the gains
of its features, and Gumbel noise from a digest of its id turns "the highest
scores" into a sample without replacement.

Distinct words, bounded by a blank on both sides, are the keys of an
Aho-Corasick automaton, and carry the CRC and the length of the word as payload. One scan of a
text emits the payloads of its words; the CRC of a run follows from adjacent
payloads alone, since ``crc(a + b)`` is ``crc(a)`` moved over ``len(b)`` zero bytes (a linear
map) xor ``crc(b)``. The dictionary is bounded and only saves work: a word that it does not hold
leaves a gap between two emissions, and its payload is computed from its own bytes.

Two passes over the corpus, each narrow: bucket counts (one row a bucket and
task is shuffled), then weights."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, with_global_index
from .words import folded

BUCKETS = 10000
#: Words of the dictionary, and the longest one in bytes: they bound what is broadcast (4 MB).
DICTIONARY_WORDS, LONGEST_KEY = 65536, 64
#: Documents, about, whose commonest words make the dictionary (no result depends on it).
DICTIONARY_SAMPLE = 20000
#: Bytes of a text that are scanned at once.
PIECE = 1 << 20


def _shift_tables() -> list[np.ndarray]:
    """For k = 0, 1, ...: the map of a CRC over ``2**k`` zero bytes, as four
    tables of 256 (one for each byte of the CRC)."""
    def zero_byte(c: int) -> int:
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        return c

    def apply(columns, c: int) -> int:
        out = 0
        for j, col in enumerate(columns):
            if c >> j & 1:
                out ^= col
        return out

    columns, tables = [zero_byte(1 << j) for j in range(32)], []
    for _ in range(32):
        tables.append(np.array([[apply(columns, v << (8 * b)) for v in range(256)] for b in range(4)], dtype=np.uint32))
        columns = [apply(columns, c) for c in columns]
    return tables


_SHIFT: list[np.ndarray] = []


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``crc`` moved over ``length`` zero bytes, elementwise."""
    if not _SHIFT:
        _SHIFT.extend(_shift_tables())
    crc, k = crc.astype(np.uint32), 0
    while len(length) and (left := length >> k).any():
        at = np.flatnonzero(left & 1)
        c, t = crc[at], _SHIFT[k]
        crc[at] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
        k += 1
    return crc


class Scanner:
    """Automaton over ``words`` (distinct folded words as bytes)."""

    def __init__(self, words: list[bytes]):
        import ahocorasick
        self.crc = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
        self.tree = ahocorasick.Automaton()
        for i, w in enumerate(words):  # one character a byte
            self.tree.add_word(f" {w.decode('latin-1')} ", i)
        self.tree.make_automaton()

    def payloads(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(CRC, length in bytes) of every word of a text, in order."""
        buf = b" " + folded(text) + b" "
        found, at = [], 0
        while at < len(buf) - 1:  # pieces begin and end with a blank, which neighbours share
            stop = len(buf) - 1
            if stop - at > PIECE:
                stop = buf.rfind(b" ", at + 1, at + PIECE)
                stop = stop if stop > at else buf.find(b" ", at + PIECE)
            found.append(self._piece(buf[at:stop + 1]))
            at = stop
        return tuple(np.concatenate(x) for x in zip(*found))

    def _piece(self, buf: bytes) -> tuple[np.ndarray, np.ndarray]:
        inside = np.frombuffer(buf, dtype=np.uint8) != 32
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        hits = list(self.tree.iter(buf.decode("latin-1"))) if len(self.crc) else []
        key = np.array([i for _, i in hits], dtype=np.int64)
        if len(hits) == len(starts):
            return self.crc[key], ends - starts
        crc, known = np.empty(len(starts), dtype=np.uint32), np.zeros(len(starts), dtype=bool)
        at = np.searchsorted(ends, np.array([e for e, _ in hits], dtype=np.int64))
        crc[at], known[at] = self.crc[key], True
        for i in np.flatnonzero(~known):
            crc[i] = zlib.crc32(buf[starts[i]:ends[i]])
        return crc, ends - starts

    def features(self, text: str | None, longest: int, buckets: int) -> tuple[int, np.ndarray]:
        """(number of words, bucket of every feature)."""
        crc, length = self.payloads(text)
        runs, found = crc, [crc % np.uint32(buckets)]
        if longest > 1 and len(crc):
            blank = np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32)
            follow = shifted(blank, length) ^ crc  # CRC of a blank and the word
            for n in range(1, min(longest, len(crc))):
                runs = shifted(runs[:-1], length[n:] + 1) ^ follow[n:]
                found.append(runs % np.uint32(buckets))
        return len(crc), np.concatenate(found).astype(np.int64)


_LOADED: dict = {"words": None, "scanner": None}


def _scanner(shared) -> Scanner:
    """The worker's automaton for a broadcast word list, built once a process."""
    if _LOADED["words"] is not shared.value:
        _LOADED.update(words=shared.value, scanner=Scanner(shared.value))
    return _LOADED["scanner"]


def dictionary(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               target_text: str = "text", limit: int = DICTIONARY_WORDS) -> list[bytes]:
    """The ``limit`` commonest words of the target and of about
    ``DICTIONARY_SAMPLE`` documents, at most ``LONGEST_KEY`` bytes each."""
    n = docs.count()
    share = min(1.0, DICTIONARY_SAMPLE / n) if n else 0.0
    chosen = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.length(text_col)), F.lit(1 << 30)) < int(share * (1 << 30))) \
        .select(F.col(text_col).alias("text")).unionByName(target.select(F.col(target_text).alias("text")))
    fold = F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                            r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    words = chosen.select(F.explode(F.split(fold, " ")).alias("w")) \
        .where(F.octet_length("w").between(1, LONGEST_KEY)).groupBy("w").count() \
        .orderBy(F.desc("count"), "w").limit(limit).select("w")
    return [r["w"].encode() for r in words.collect()]  # <= limit words


def bucket_counts(rows: DataFrame, shared, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """Occurrences of every bucket over all rows. A task emits one row a bucket it met."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, sums = _scanner(shared), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                sums += np.bincount(scanner.features(text.as_py(), longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    found = rows.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(count, "bucket bigint, n bigint") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # <= buckets rows
    out = np.zeros(buckets, dtype=np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of every bucket, B their number."""
    b, big_s, big_t = float(len(corpus)), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (big_s + b) / ((s + 1.0) * (big_t + b))))
                     for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def noise(id_: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from a digest of the seed and the id (null: the empty text)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def weighed(docs: DataFrame, target: DataFrame, into: str, id_col: str = "doc_id", text_col: str = "text",
            target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: str = "2024",
            words: list[bytes] | None = None) -> DataFrame:
    """``docs`` with a column ``into``: ``struct(n_words, n_features, weight,
    score)``. ``words`` replaces the dictionary (no result depends on it)."""
    words = dictionary(docs, target, id_col, text_col, target_text) if words is None else words
    shared = docs.sparkSession.sparkContext.broadcast(words)  # bounded by DICTIONARY_WORDS and LONGEST_KEY
    table = {"gain": gains(bucket_counts(docs, shared, text_col, longest, buckets),
                           bucket_counts(target, shared, target_text, longest, buckets))}

    @F.pandas_udf("n_words bigint, n_features bigint, weight bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner, gain = _scanner(shared), table["gain"]
        for s in batches:
            rows = []
            for text in s:
                n, found = scanner.features(text, longest, buckets)
                rows.append((n, len(found), int(gain[found].sum())))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    raw = fresh(docs, "_weighed")
    out = docs.withColumn(raw, run.asNondeterministic()(F.col(text_col)))
    return out.withColumn(into, F.struct(F.col(f"{raw}.n_words"), F.col(f"{raw}.n_features"), F.col(f"{raw}.weight"),
                                         (F.col(f"{raw}.weight") + noise(F.col(id_col), seed)).alias("score"))).drop(raw)


def ranked(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
           longest: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: str = "2024",
           words: list[bytes] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_words, n_features, weight,
    score, rank``.

    Of the N rows with at least ``least_words`` words the ``percent * N // 100`` highest scores
    are drawn and ranked from 1, ties to the smaller id (null last; rows alike in
    both are interchangeable); ``rank`` of the others is null. Null and empty
    texts have no features and weight 0. An empty target makes every gain that of an unseen bucket.
    Long texts are scanned in pieces; repeated rows are scored each on its own and
    share one score. Ranks come from a range partitioned sort of narrow rows."""
    found = weighed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), target.select(F.col(target_text).alias("text")),
                    "w", "id", "text", "text", longest, buckets, seed, words)
    rows = checkpointed(found.select("id", "w.*"))
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    placed = with_global_index(rows.where(able), [-F.col("score"), F.col("id").isNull(), F.col("id")], "at")
    rank = F.when(F.col("at") < drawn, F.col("at") + 1)
    return placed.withColumn("rank", rank).drop("at").unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("bigint"))) \
        .withColumnRenamed("id", id_col)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             longest: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """The rows of ``docs`` that are drawn, all their columns as they are. The
    last score is found on narrow rows; documents themselves are not moved. Rows that
    repeat the last drawn one (same id and score) are all returned."""
    words = dictionary(docs, target, id_col, text_col, target_text)
    mark = fresh(docs, "_importance")
    found = weighed(docs, target, mark, id_col, text_col, target_text, longest, buckets, seed, words)
    able = found.where(F.col(f"{mark}.n_words") >= least_words)
    narrow = checkpointed(able.select(F.col(id_col).alias("id"), F.col(f"{mark}.score").alias("score")))
    drawn = narrow.count() * percent // 100
    last = with_global_index(narrow, [-F.col("score"), F.col("id").isNull(), F.col("id")], "at").where(F.col("at") == drawn - 1).first()
    if last is None:
        return docs.limit(0)
    score = F.col(f"{mark}.score")
    level = F.lit(True) if last["id"] is None else F.coalesce(F.col(id_col) <= F.lit(last["id"]), F.lit(False))
    return able.where((score > last["score"]) | ((score == last["score"]) & level)).drop(mark)
