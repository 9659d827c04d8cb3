"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items make one suffix automaton: its states are the
classes of word sequences that occur at the same places of the items, so following a document's
words through it (and the suffix link where a word does not go on) tracks the longest sequence
that ends at each word and occurs in some item. Where that is at least ``WINDOW`` words, the last
``WINDOW`` words are a window of an item; the state above which sequences get shorter than the window
names the items. An item of fewer words is one window of its own, found on the chain of suffix links.

Most text never comes near an item, so documents are first cut, by a table of
hashed word pairs, into stretches in which every two neighbours are neighbours in some item; a
window lies in one stretch, and stretches shorter than the shortest window are passed over.

Items are dealt to parts of at most ``PART_WORDS`` words (long items in
overlapping pieces), each part's automaton is built in a task and stored in the shared folder. Documents pass
the parts one after the other, so what is broadcast at a time is bounded whatever the size of the items."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import checkpointed, fresh
from .words import folded

WINDOW = 10
#: Words, and bytes of words (but for one piece), of an automaton that is broadcast; words of a piece.
PART_WORDS, PART_BYTES, PIECE_WORDS = 200_000, 16 << 20, 4096
#: Bits of the table of word pairs.
PAIR_BITS = 22
SPANS = "array<struct<start:int,stop:int,longest:int,first_byte:bigint,last_byte:bigint>>"
RESULT = f"n_words bigint, n_hit bigint, spans {SPANS}, items array<string>"
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton:
    """Suffix automaton over ``pieces``: pairs of an item's id and a list of
    its words (bytes); a piece of fewer than ``window`` words is a whole item."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in pieces if words]
        self.shortest = min([window] + [len(w) for _, w in coded])
        self.goes: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._mark(coded)
        self.pairs = np.zeros(1 << PAIR_BITS, dtype=bool)
        for _, words in coded:
            a = np.array(words, dtype=np.int64)
            self.pairs[_pair(a[:-1], a[1:])] = True
        self.step = self._flat()

    def _state(self, length: int, link: int, goes: dict) -> int:
        self.goes.append(goes)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int) -> int:
        """The state that ``p`` with ``w`` leads to, parted from longer sequences if needed."""
        q = self.goes[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, self.link[q], dict(self.goes[q]))
        self.link[q] = part
        while p >= 0 and self.goes[p].get(w) == q:
            self.goes[p][w] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, w: int) -> int:
        if w in self.goes[last]:  # the sequence occurs already
            return self._split(last, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.goes[p]:
            self.goes[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def _mark(self, coded) -> None:
        """Window states with their items, and whole short items by state."""
        n, window = len(self.link), self.window
        self.holds = [-1] * n  # state of the last `window` words of a longer sequence
        self.short_up = [-1] * n  # nearest state up the links, itself included, with a short item
        self.short, self.items = {}, {}
        ends = []
        for item, words in coded:
            v, whole = 0, len(words) < window
            for i, w in enumerate(words):
                v = self.goes[v][w]
                if not whole and i >= window - 1:
                    ends.append((v, item))
            if whole:
                self.short.setdefault(v, set()).add((len(words), item))
        for v in np.argsort(np.array(self.length), kind="stable").tolist():
            up = self.link[v]
            if self.length[v] >= window:
                self.holds[v] = v if self.length[up] < window else self.holds[up]
            self.short_up[v] = v if v in self.short else (self.short_up[up] if up >= 0 else -1)
        for v, item in ends:
            self.items.setdefault(self.holds[v], set()).add(item)

    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.vocabulary)
        keys = np.array([v * n + w for v, go in enumerate(self.goes) for w in go], dtype=np.int64)
        values = np.array([q for go in self.goes for q in go.values()], dtype=np.int32)
        del self.goes
        return keys, values

    def packed(self) -> bytes:
        """The automaton as bytes (plain values and arrays)."""
        lists = {k: np.array(getattr(self, k), dtype=np.int32) for k in ("link", "length", "holds", "short_up")}
        return pickle.dumps(self.__dict__ | lists | {"pairs": np.packbits(self.pairs)}, 5)

    @classmethod
    def unpacked(cls, data: bytes) -> "Automaton":
        self = cls.__new__(cls)
        self.__dict__.update(pickle.loads(data))
        for k in ("link", "length", "holds", "short_up"):
            setattr(self, k, getattr(self, k).tolist())
        self.pairs = np.unpackbits(self.pairs).astype(bool)
        self.step = dict(zip(*(x.tolist() for x in self.step)))
        return self

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Word ranges in which neighbours may be neighbours in an item."""
        if not len(ids):
            return
        known = ids >= 0
        joined = known[:-1] & known[1:]
        joined[joined] = self.pairs[_pair(ids[:-1][joined], ids[1:][joined])]
        cuts = np.flatnonzero(~joined) + 1
        starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(ids)]))
        good = (stops - starts >= self.shortest) & known[starts]
        yield from zip(starts[good].tolist(), stops[good].tolist())

    def follow(self, words: list[int], base: int, spans: list, windows: set, items: set) -> None:
        """Track the longest match over ``words``, which begin at word ``base``
        of the text; append hit ranges ``[start, stop, longest]`` to ``spans``
        (touching or overlapping ranges of one stretch are one)."""
        step, link, length, window, n = self.step, self.link, self.length, self.window, len(self.vocabulary)
        v = have = 0
        for i, w in enumerate(words, base + 1):
            q = step.get(v * n + w)
            while q is None and v:
                v = link[v]
                have = length[v]
                q = step.get(v * n + w)
            if q is None:
                continue
            v, have, hit = q, have + 1, 0
            if have >= window:
                hit = window
                windows.add(self.holds[v])
            if self.short:
                u = self.short_up[v]
                while u >= 0:
                    for size, item in self.short.get(u, ()):
                        if size <= have:
                            hit = max(hit, size)
                            items.add(item)
                    u = self.short_up[link[u]] if link[u] >= 0 else -1
            if hit:
                start, longest = i - hit, have
                while spans and spans[-1][1] >= start and spans[-1][1] > base:
                    old = spans.pop()
                    start, longest = min(start, old[0]), max(longest, old[2])
                spans.append([start, i, longest])

    def scan(self, text: str | None) -> tuple[int, int, list, list]:
        """(words, hit words, spans, items) of a text."""
        if not text:
            return 0, 0, [], []
        buf = folded(text)
        words = buf.split()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        spans, windows, items = [], set(), set()
        for a, b in self.stretches(ids):
            self.follow(ids[a:b].tolist(), a, spans, windows, items)
        if not spans:
            return len(words), 0, [], []
        inside = np.concatenate(([False], np.frombuffer(buf, dtype=np.uint8) != 32, [False]))
        first, last = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        spans = [{"start": a, "stop": b, "longest": n, "first_byte": int(first[a]), "last_byte": int(last[b - 1])} for a, b, n in spans]
        items.update(*(self.items[u] for u in windows))
        return len(words), sum(s["stop"] - s["start"] for s in spans), spans, sorted(items)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of a pair of word numbers in the table of pairs."""
    return (a * 2654435761 + b * 40503) & ((1 << PAIR_BITS) - 1)


def build(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
          part_words: int = PART_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """The parts' automata, ``automaton binary``, stored in the shared folder.
    Null ids count as the empty text; null texts and texts without a word give nothing."""
    fold = F.regexp_replace(F.translate(F.col(text_col), _A, _Z), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    words = F.filter(F.split(fold, " "), lambda w: w != "")
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(piece_words))
    pieces = checkpointed(rows.select("item", "words", F.explode(starts).alias("start"))
                          .select("item", F.slice("words", F.col("start") + 1, F.lit(piece_words + window - 1)).alias("words")))
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group):
            return pa.RecordBatch.from_arrays([pa.array([Automaton(group, window).packed()], pa.binary())], names=["automaton"])
        group, held, size = [], 0, 0
        for batch in batches:
            for item, words in zip(batch.column(0), batch.column(1)):
                words = [w.encode() for w in words.as_py()]
                if group and (held + len(words) > part_words or size > PART_BYTES):
                    yield out(group)
                    group, held, size = [], 0, 0
                group.append((item.as_py(), words))
                held, size = held + len(words), size + sum(map(len, words))
        if group:
            yield out(group)

    path = scratch_path(items.sparkSession, "automata")
    pieces.repartition(max(1, -(-total // part_words))).mapInArrow(built, "automaton binary").write.parquet(path)
    return items.sparkSession.read.parquet(path)


_LOADED: dict = {"bytes": None, "automaton": None}


def _scan_column(shared, text: Column) -> Column:
    """``struct(n_words, n_hit, spans, items)`` of a text by a broadcast automaton."""
    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if _LOADED["bytes"] is not shared.value:
            _LOADED.update(bytes=shared.value, automaton=Automaton.unpacked(shared.value))
        scan = _LOADED["automaton"].scan
        for s in batches:
            yield pd.DataFrame([scan(t) for t in s], columns=["n_words", "n_hit", "spans", "items"])
    return run.asNondeterministic()(text)


def _merged(spans: list) -> list:
    """Spans of several parts as one list: overlapping ones become one."""
    out = []
    for s in sorted((dict(s) for s in spans), key=lambda s: s["start"]):
        if out and s["start"] < out[-1]["stop"]:
            last = out[-1]
            if s["stop"] > last["stop"]:
                last.update(stop=s["stop"], last_byte=s["last_byte"])
            last["longest"] = max(last["longest"], s["longest"])
        else:
            out.append(s)
    return out


def matched(docs: DataFrame, items: DataFrame, into: str, text_col: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = WINDOW, part_words: int = PART_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """``docs`` with a column ``into``: ``struct(n_words, n_hit, spans, items)``.

    A span is a run of hit words ``[start, stop)`` with the longest match that ends in it
    and its byte range in the text's UTF-8; ``items`` are the ids (as text, sorted)
    of the items with a window in the text. Null and empty texts have none. Repeated items
    count once by id, repeated rows are scanned each on their own, and a text is scanned whole
    whatever its length. Without items nothing is hit.

    With one part this is one narrow pass. With more, the rows are numbered and
    stored, each part adds rows for the documents it hits, and they are merged by number."""
    spark = docs.sparkSession
    parts = build(items, item_id, item_text, window, part_words, piece_words)
    n = parts.count()
    # a part is bounded by PART_WORDS and PART_BYTES; one is on the driver at a time
    each = (bytes(r["automaton"]) for r in parts.toLocalIterator()) if n else iter([Automaton([], window).packed()])
    text = F.col(text_col)
    if n <= 1:
        return docs.withColumn(into, _scan_column(spark.sparkContext.broadcast(next(each)), text))
    place = fresh(docs, "_place")
    rows = checkpointed(docs.withColumn(place, F.monotonically_increasing_id()))
    paths = []
    for k, part in enumerate(each):
        shared = spark.sparkContext.broadcast(part)
        found = rows.select(F.col(place).alias("place"), _scan_column(shared, text).alias("r")).select("place", "r.*")
        paths.append(scratch_path(spark, f"matched-{k}"))
        found.where(F.lit(k == 0) | (F.col("n_hit") > 0)).write.parquet(paths[-1])
        shared.unpersist()

    @F.pandas_udf(SPANS)
    def joined(lists: pd.Series) -> pd.Series:
        return lists.map(_merged)

    merged = spark.read.parquet(*paths).groupBy("place").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.withColumn("spans", joined.asNondeterministic()("spans"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    merged = merged.select(F.col("place").alias(place), F.struct("n_words", hit.alias("n_hit"), "spans", "items").alias(into))
    return rows.join(merged, place).select(*docs.columns, into)


def flags(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", window: int = WINDOW, **sizes) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_words, n_hit, n_items,
    items_sha256, contaminated, spans, items``; the digest is over the sorted
    item ids, comma-joined."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = matched(rows, items, "m", "text", item_id, item_text, window, **sizes)
    return found.select(F.col("id").alias(id_col), "m.n_words", "m.n_hit", F.size("m.items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "m.items"), 256).alias("items_sha256"), (F.col("m.n_hit") > 0).alias("contaminated"),
                        "m.spans", "m.items")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
          window: int = WINDOW, least_longest: int = WINDOW, most_coverage: float = 0.5, **sizes) -> DataFrame:
    """``docs`` without what the items hold: spans whose longest match has
    ``least_longest`` words or more are taken out of the text, and documents of whose
    words more than ``most_coverage`` are hit go. Other columns stay as they are."""
    mark = fresh(docs, "_matched")
    found = matched(docs, items, mark, text_col, item_id, item_text, window, **sizes)
    share = F.col(f"{mark}.n_hit") / F.greatest(F.col(f"{mark}.n_words"), F.lit(1))

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def cut(text, found):
            drop = [s for s in found if s["longest"] >= least_longest] if text else []
            if not drop:
                return text
            raw, at, out = text.encode(), 0, []
            for s in drop:
                out.append(raw[at:s["first_byte"]])
                at = s["last_byte"]
            return b"".join([*out, raw[at:]]).decode()
        return pd.Series([cut(t, s) for t, s in zip(texts, spans)], dtype=object)

    return found.where(share <= most_coverage).withColumn(text_col, without(F.col(text_col), F.col(f"{mark}.spans"))).drop(mark)
