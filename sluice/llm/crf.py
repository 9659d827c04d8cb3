r"""Quality rules with line sequence labelling.

Fixed rules look at word counts and repeated word windows. Texts that pass
them are labelled line by line: a linear-chain conditional random field with
the two states *boilerplate* and *content* is decoded by the Viterbi rule, and
a text is kept if its content lines hold at least ``CONTENT_SHARE`` of its
word characters.

The field is trained here, by maximum conditional likelihood, on neighbouring lines of
a bounded sample of labelled documents (``SAMPLE_ROWS``, chosen by a hash of
the id; ``SAMPLE_LINES`` lines that follow each other in a document, from a place chosen likewise): lines of good
documents count as content, lines of bad ones as boilerplate. A document has one label, so a change of
state is learned from sequences put together here: runs of neighbouring lines of good and of bad documents in
turn. Lines that look like those of good documents come out as content
wherever they stand, because far more good documents have them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents the field is trained on, about, and neighbouring lines of each.
SAMPLE_ROWS, SAMPLE_LINES = 6000, 40
#: Joined sequences for each document sampled, their runs, and the lines of a run, at most.
JOINED_SHARE, JOINED_RUNS, RUN_LINES = 0.5, 5, 8
#: Rules: fewest words, largest percentage of words in repeated windows, window length.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Smallest share of word characters in content lines.
CONTENT_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
_WS = " \t\n\x0b\x0c\r"

RESULT = T.StructType([T.StructField(n, T.LongType()) for n in
                       ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] +
                      [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
                       T.StructField("content_share", T.DoubleType()), T.StructField("n_lines", T.LongType()),
                       T.StructField("n_content_lines", T.LongType())])


# --- words and fixed rules --------------------------------------------------------

def split_words(text: str) -> list[str]:
    """Words ``[^\x20\x09-\x0D]+``: white space is ASCII only."""
    return [w.decode("utf-8") for w in text.encode("utf-8").split()]


def repeated_window_words(words: list, n: int = WINDOW) -> int:
    """Words that lie in a window of ``n`` words found twice or more (the first one included)."""
    if len(words) < n + 1:
        return 0
    grams = list(zip(*[words[i:] for i in range(n)]))
    if len(set(grams)) == len(grams):
        return 0
    count = Counter(grams)
    covered, end = 0, 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered += i + n - max(i, end)
            end = i + n
    return covered


def base_counts(text: str | None) -> tuple:
    """(words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a
    whole text; words as bytes."""
    text = text or ""
    words = text.encode("utf-8").split()
    n_symbols = sum(map(text.count, SYMBOLS))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.strip(_WS))
        else:
            seen.add(line)
    word_chars = len(text) - sum(map(text.count, _WS))
    return words, len(words), word_chars, n_symbols, dup, repeated_window_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


# --- line features ----------------------------------------------------------------

_SHARE_BINS = np.array([0.02, 0.08, 0.2, 0.4, 0.7])
_COUNT_BINS = np.array([1, 3, 6, 12, 30])
#: Features of a line: six shares in bins, word count in bins, end mark, first letter, seen before, bias.
_SHARES = 6
N_FEATURES = (_SHARES) * (len(_SHARE_BINS) + 1) + len(_COUNT_BINS) + 1 + 5
_PUNCTUATION = re.compile(r"[^\w\s]")
_DIGITS = re.compile(r"\d")


def line_numbers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word -> (numbers of each line, its word characters)."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        n = len(words)
        chars = sum(map(len, words))
        symbols = sum(map(line.count, SYMBOLS))
        upper = sum(map(str.isupper, words))
        punct = len(_PUNCTUATION.findall(line))
        digits = len(_DIGITS.findall(line))
        repeats = sum(map(str.__eq__, words, words[1:]))
        kinds = len(set(words))
        last = line.rstrip()[-1:]
        rows.append((symbols / chars, upper / n, punct / chars, digits / chars, repeats / n, 1 - kinds / n, n,
                     last in ".!?:\"”»", words[0][:1].isupper(), line in seen, "!!" in line))
        sizes.append(chars)
        seen.add(line)
    return np.array(rows, dtype=np.float64).reshape(-1, 11), np.array(sizes, dtype=np.int64)


def featurize(numbers: np.ndarray) -> np.ndarray:
    """Active feature positions of each line (a fixed number of one-hot groups)."""
    groups, base = [], 0
    for k in range(_SHARES):
        groups.append(base + np.searchsorted(_SHARE_BINS, numbers[:, k], side="left"))
        base += len(_SHARE_BINS) + 1
    groups.append(base + np.searchsorted(_COUNT_BINS, numbers[:, 6], side="right"))
    base += len(_COUNT_BINS) + 1
    x = np.zeros((len(numbers), N_FEATURES))
    for g in groups:
        x[np.arange(len(numbers)), g] = 1.0
    x[:, base:base + 4] = numbers[:, 7:11]
    x[:, base + 4] = 1.0
    return x


@dataclass
class Field:
    """Two-state linear chain: emission weights (features x 2), transitions (2 x 2) and first states."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best state (1: content) of each line, by the Viterbi rule."""
        e = (x @ self.emit).tolist()
        if not e:
            return np.zeros(0, dtype=np.int64)
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.start[0] + e[0][0], self.start[1] + e[0][1]
        back = []
        for e0, e1 in e[1:]:
            fa, fb = b + m10 > a + m00, b + m11 > a + m01
            back.append((fa, fb))
            a, b = (b + m10 if fa else a + m00) + e0, (b + m11 if fb else a + m01) + e1
        state = int(b >= a)
        out = [state]
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return np.array(out[::-1])

    def content(self, text: str) -> tuple[float, int, int]:
        """(content share, lines, content lines) of a text; share 0 without a word."""
        numbers, sizes = line_numbers(text)
        if not len(sizes):
            return 0.0, 0, 0
        state = self.decode(featurize(numbers))
        return float((sizes * state).sum() / sizes.sum()), len(sizes), int(state.sum())


def joined(sequences: list[tuple[np.ndarray, int]], seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences with changes of state: runs of neighbouring lines of good and
    of bad documents in turn, each run from another document."""
    sides = [[s for s, y in sequences if y == state] for state in (0, 1)]
    if not sides[0] or not sides[1]:
        return []
    rng, out = np.random.default_rng(seed), []
    for _ in range(int(JOINED_SHARE * len(sequences))):
        rows, states, state = [], [], int(rng.integers(2))
        for _ in range(int(rng.integers(2, JOINED_RUNS + 1))):
            lines = sides[state][int(rng.integers(len(sides[state])))]
            size = min(len(lines), int(rng.integers(1, RUN_LINES + 1)))
            at = int(rng.integers(len(lines) - size + 1))
            rows.append(lines[at:at + size])
            states += [state] * size
            state = 1 - state
        out.append((np.concatenate(rows), np.array(states)))
    return out


def train(sequences: list[tuple[np.ndarray, int | np.ndarray]], steps: int = 80, rate: float = 0.2, decay: float = 1e-3) -> Field:
    """Maximum conditional likelihood by gradient ascent (Adam) over padded
    sequences ``(numbers, states)`` (one state for all lines, or one a line), all of them in each step.
    Without sequences, every line is content."""
    if not sequences:
        field = Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
        field.emit[-1, 1] = 1.0
        return field
    longest = max(len(numbers) for numbers, _ in sequences)
    n = len(sequences)
    x = np.zeros((n, longest, N_FEATURES), dtype=np.float32)
    mask = np.zeros((n, longest), dtype=bool)
    gold = np.zeros((n, longest), dtype=np.int64)
    for i, (numbers, y) in enumerate(sequences):
        x[i, :len(numbers)] = featurize(numbers)
        mask[i, :len(numbers)] = True
        gold[i, :len(numbers)] = y
    flat = x[mask]
    one_hot = np.eye(2)
    params = [np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    scale = 1.0 / mask.sum()
    pair = mask[:, 1:] & mask[:, :-1]
    target_move = np.einsum("nti,ntj->ij", one_hot[gold[:, :-1]] * pair[..., None], one_hot[gold[:, 1:]])
    target_start = one_hot[gold[:, 0]].sum(axis=0)
    target = np.zeros((n, longest, 2))
    target[mask] = one_hot[gold[mask]]
    for step in range(1, steps + 1):
        emit, move, start = params
        e = np.zeros((n, longest, 2))
        e[mask] = flat @ emit
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            prev = np.logaddexp.reduce(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], prev, 0.0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        gamma = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        xi = np.exp(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) \
            * pair[..., None, None]
        grads = [flat.T @ (target - gamma)[mask], target_move - xi.sum(axis=(0, 1)), target_start - gamma[:, 0].sum(axis=0)]
        for k, g in enumerate(grads):
            g = g * scale - decay * params[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] = params[k] + rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return Field(*params)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Field:
    """Field trained on about ``sample_rows`` labelled documents, a quarter of
    them at least bad ones where there are as many (label 0; any other label
    is good; null labels and texts are left out). A document gives at most
    ``SAMPLE_LINES`` neighbouring lines."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("id")).agg(F.min((F.col(label_col) != 0).cast("int")).alias("y"))
    marked = marked.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {0: sample_rows // 4, 1: sample_rows - sample_rows // 4}
    keep = F.lit(False)
    for y, n in sizes.items():
        keep = keep | ((F.col("y") == y) & (F.col("h") <= min(1 << 30, int(share[y] / n * (1 << 30)))))
    chosen = marked.where(keep).select("id", "y", "h")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def numbers(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, places in batches:
            out = []
            for t, h in zip(texts, places):
                m, _ = line_numbers(t)
                at = h % max(1, len(m) - SAMPLE_LINES + 1)
                out.append(m[at:at + SAMPLE_LINES].ravel())
            yield pd.Series(out)

    # about sample_rows ids of 8 bytes: small enough to broadcast by the parameter
    rows = texts.join(F.broadcast(chosen), "id").select("id", "y", numbers.asNondeterministic()("text", "h").alias("m")) \
        .toPandas().sort_values("id", kind="stable")
    found = [(np.array(m, dtype=np.float64).reshape(-1, 11), int(y)) for m, y in zip(rows["m"], rows["y"])]
    found = [f for f in found if len(f[0])]
    return train(found + joined(found))


# --- the operator -----------------------------------------------------------------

def judge_column(field: Field, text: Column) -> Column:
    """Counts and verdict of a text column as one struct (``RESULT``)."""
    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                _, n, chars, symbols, dup, repeat = base_counts(t)
                failed = base_failed(n, repeat)
                share, lines, content = field.content(t or "")
                rows.append((n, chars, symbols, dup, repeat, failed, not failed and share >= CONTENT_SHARE,
                             share, lines, content))
            yield pd.DataFrame(rows, columns=RESULT.names)
    return run.asNondeterministic()(text)


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, base counts, ``base_failed``,
    ``kept`` and the line labelling's share and counts. A null text has no
    words (``base_failed``). One narrow pass over whole texts."""
    return docs.select(F.col(id_col), judge_column(field, F.col(text_col)).alias("_r")).select(id_col, "_r.*")
