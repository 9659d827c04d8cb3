"""Quality classifier: naive Bayes support vectors.

A text becomes indicators of character trigrams and of word-shape n-grams,
each scaled by the log-count ratio of its presence in good and bad texts, and
the vector is brought to unit length. A linear hinge-loss model over these
vectors is fitted by dual coordinate descent, and the margin becomes a score
from 0 to 1 by a logistic curve fitted on margins of rows left out in turn.

Learning uses a bounded sample of labelled rows (``SAMPLE_ROWS``, chosen by a
hash of the id); only their hashed indicators reach the driver. Labels,
language, source and id are never inputs of a score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Indicators are hashed to this many bits.
BITS = 17
#: Labelled rows the model is fitted on, about; a quarter of them bad ones where there are as many.
SAMPLE_ROWS = 6000
#: Additive smoothing of document counts, cost of a margin violation, passes over the rows, folds of the score curve.
ALPHA, COST, PASSES, FOLDS = 1.0, 4.0, 30, 3
#: Characters and words turned into indicators at a time.
CHUNK = 1 << 16

RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                       T.StructField("margin", T.DoubleType())])
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shape(word: str) -> int:
    """Rough form of a word, as a small number: case, digits, leading and trailing marks, length."""
    core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    tail = word[-1:]
    mark = 0 if tail.isalnum() else 1 + (ord(tail) & 63)
    if not core:
        kind = 0
    elif core.isupper():
        kind = 1
    elif core[0].isupper():
        kind = 2
    elif core.islower():
        kind = 3
    else:
        kind = 4
    size = min(len(core), 12) // 4
    return ((mark * 5 + kind) * 4 + size) * 2 + any(map(str.isdigit, core))


def indicators(text: str | None) -> np.ndarray:
    """Sorted distinct hashed indicators of a whole text; none for a null or empty one."""
    if not text:
        return np.zeros(0, dtype=np.int32)
    found = []
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for a in range(0, len(cp), CHUNK):
        w = cp[a:a + CHUNK + 2].astype(np.uint64)
        if len(w) < 3:
            continue
        h = ((w[:-2] * _M1 + w[1:-1]) * _M2 + w[2:]) * _M3
        found.append(np.unique(h >> np.uint64(64 - BITS)))
    words = text.split()
    known: dict[str, int] = {}
    shapes = np.empty(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        s = known.get(w)
        if s is None:
            s = known[w] = shape(w)
        shapes[i] = s
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
    again = np.zeros(len(words), dtype=np.uint64)
    again[1:] = ids[1:] == ids[:-1]
    s = (shapes * np.uint64(2) + again + np.uint64(7)) * _M2
    for k in range(1, 4):  # shape n-grams of one to three words
        if len(s) < k:
            break
        h = np.full(len(s) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            h = (h * _M1) ^ s[j:len(s) - k + 1 + j]
        found.append(np.unique((h * _M3) >> np.uint64(64 - BITS)))
    return np.unique(np.concatenate(found)).astype(np.int32) if found else np.zeros(0, dtype=np.int32)


@dataclass
class Model:
    ratio: np.ndarray   # log-count ratio of each indicator
    weight: np.ndarray  # linear model over scaled indicators
    bias: float
    slope: float        # logistic curve over the margin
    offset: float

    def margin(self, found: np.ndarray) -> float:
        """Signed distance of a text's unit vector; the bias alone for a text without indicators."""
        r = self.ratio[found]
        norm = float(np.sqrt((r * r).sum()))
        return float((r * self.weight[found]).sum() / norm + self.bias) if norm > 0 else self.bias

    def score(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -700, 700))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    good, bad = np.full(1 << BITS, ALPHA), np.full(1 << BITS, ALPHA)
    for found, label in zip(rows, y):
        (good if label > 0 else bad)[found] += 1
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, seed: int = 7) -> tuple:
    """Hinge-loss linear model by dual coordinate descent (Hsieh et al., 2008):
    one dual variable a row, moved to its optimum in turn within [0, cost]."""
    rng = np.random.default_rng(seed)
    values, norms = [], np.ones(len(rows))
    for i, found in enumerate(rows):
        v = ratio[found]
        n = np.sqrt((v * v).sum())
        values.append(v / n if n > 0 else v)
        norms[i] = 2.0 if n > 0 else 1.0  # the unit vector and the bias input
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    for _ in range(PASSES):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the score curve, by Newton steps on smoothed targets (Platt)."""
    good, bad = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (good + 1.0) / (good + 2.0), 1.0 / (bad + 2.0))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * margins + b, -500, 500)))
        grad = x @ (target - p)
        hess = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        da, db = np.linalg.solve(hess, grad)
        size = max(abs(da), abs(db), 1.0)
        a, b = a + da / size, b + db / size
        if max(abs(da), abs(db)) < 1e-8:
            break
    return max(float(a), 1e-6), float(b)


def train(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Model of indicator rows and labels (+1 good, -1 bad). With one class
    only (or no row) every text scores that class (good without any row)."""
    if not len(y) or (y > 0).all() or (y < 0).all():
        sign = 1.0 if not len(y) or y[0] > 0 else -1.0
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), sign, 3.0, 0.0)

    def fitted(keep: np.ndarray) -> tuple:
        own, label = [rows[i] for i in keep], y[keep]
        ratio = log_count_ratio(own, label)
        w, bias = dual_descent(own, label, ratio, np.full(len(label), COST))
        return ratio, w, bias

    order = np.arange(len(y))
    margins = np.zeros(len(y))
    for fold in range(FOLDS):
        out = order % FOLDS == fold
        if not 0 < (y[~out] > 0).sum() < (~out).sum():
            continue
        part = Model(*fitted(order[~out]), 1.0, 0.0)
        margins[out] = [part.margin(rows[i]) for i in order[out]]
    ratio, w, bias = fitted(order)
    return Model(ratio, w, bias, *logistic_curve(margins, y))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from the documents of ``docs`` that ``labels`` marks (0 bad, else
    good; null labels and ids are left out, of several labels the lowest
    holds). About ``sample_rows`` rows are used, the same ones in every run."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("id")).agg(F.min((F.col(label_col) != 0).cast("int")).alias("y")) \
        .withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {0: sample_rows // 4, 1: sample_rows - sample_rows // 4}
    keep = F.lit(False)
    for y, n in sizes.items():
        keep = keep | ((F.col("y") == y) & (F.col("h") <= min(1 << 30, int(share[y] / n * (1 << 30)))))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([indicators(t) for t in s])

    # about sample_rows ids of 8 bytes: small enough to broadcast by the parameter
    chosen = F.broadcast(marked.where(keep).select("id", "y"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id") \
        .select("id", "y", found.asNondeterministic()("text").alias("f")).toPandas().sort_values("id", kind="stable")
    return train([np.asarray(f, dtype=np.int64) for f in rows["f"]],
                 np.where(rows["y"].to_numpy() > 0, 1.0, -1.0) if len(rows) else np.zeros(0))


def score_column(model: Model, text: Column) -> Column:
    """``struct(score, predicted, margin)`` of a text column; null and empty texts get the bias' score."""
    shared = {"model": model}

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared["model"]
        for s in batches:
            margins = [m.margin(indicators(t)) for t in s]
            scores = [m.score(x) for x in margins]
            yield pd.DataFrame({"score": scores, "predicted": pd.Series([int(x >= 0.5) for x in scores], dtype="int32"),
                                "margin": margins})
    return run.asNondeterministic()(text)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, score, predicted, margin``. One narrow pass over whole texts."""
    return docs.select(F.col(id_col), score_column(model, F.col(text_col)).alias("_r")).select(id_col, "_r.*")
