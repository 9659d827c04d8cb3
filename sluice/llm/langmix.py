"""Language identification by multilingual mixture inference.

A document is a bag of letter trigrams drawn from a mixture of languages.
Expectation-maximisation estimates its proportions from the trigrams'
likelihoods under each language's model; the set of languages grows from the
best single one as long as the log-likelihood gains more than a penalty for
each added language. The shares of the languages sum to 1 whatever the text
is; how much of it they explain is told apart (``known``), against a law
under which every trigram is equally likely, admitted for the same penalty.

The models are trigram counts over labelled rows: about
``per_language`` rows a language, chosen by a hash of the id (the bound is the
parameter; languages with fewer rows are used whole). Counting runs in the
tasks; the driver receives at most ``2 ** BITS`` counts a language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Trigrams are hashed to this many bits.
BITS = 16
#: Labelled rows a language's model is fitted on, about.
PER_LANGUAGE = 4000
#: Additive smoothing of trigram counts.
SMOOTHING = 0.5
#: Log-likelihood that a further language must gain, for each unit of log(trigrams);
#: trigrams overlap and so count about three times.
PENALTY = 6.0
EM_STEPS, EM_STOP = 40, 1e-4
#: Prediction for a text that is null or has no letter.
UNDETERMINED = "und"
#: Trigrams hashed at a time.
CHUNK = 1 << 18

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("languages", T.ArrayType(T.StructType([
                           T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))),
                       T.StructField("known", T.DoubleType())])


def letter_table() -> np.ndarray:
    """For each code point of the basic plane: is it a letter (Unicode categories L*)?"""
    return np.fromiter((chr(c).isalpha() for c in range(1 << 16)), dtype=bool, count=1 << 16)


def _is_letter(cp: np.ndarray, letters: np.ndarray) -> np.ndarray:
    ok = letters[np.minimum(cp, 0xFFFF)]
    far = np.flatnonzero(cp > 0xFFFF)
    if len(far):
        values, at = np.unique(cp[far], return_inverse=True)
        ok[far] = np.array([chr(c).isalpha() for c in values.tolist()])[at]
    return ok


def trigram_counts(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams, counts) of the lower-cased text; a run of other
    characters than letters is one blank, windows with a blank in the middle
    are left out. Empty arrays for a text without letters."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ok = _is_letter(cp, letters)
    keep = ok.copy()
    keep[1:] |= ok[:-1]
    blank = np.full(1, 32, np.uint32)
    cp = np.concatenate((blank, np.where(ok, cp, 32)[keep], blank))
    hashes = []
    for a in range(0, len(cp) - 2, CHUNK):
        w = cp[a:a + CHUNK + 2].astype(np.uint64)
        h = (w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:]
        h = (h * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - BITS)
        hashes.append(h[w[1:-1] != 32].astype(np.int32))
    return np.unique(np.concatenate(hashes), return_counts=True) if hashes else (cp[:0], cp[:0])


@dataclass
class Model:
    languages: list[str]
    prob: np.ndarray  # trigram hash x language

    def mixture(self, grams: np.ndarray, counts: np.ndarray) -> list[tuple[str, float]]:
        """Languages and their shares (largest first) of one bag of trigrams."""
        p = self.prob[grams]
        c = counts.astype(np.float64)
        n = c.sum()
        like = c @ np.log(p)
        chosen, best = [int(np.argmax(like))], float(np.max(like))
        share = np.ones(1)
        cost = PENALTY * np.log(max(n, 2.0))
        mix = p[:, chosen[0]]
        while len(chosen) < len(self.languages):
            # the likelihood is concave in the shares: this slope bounds what any language can add
            slope = (c / mix) @ p - n
            slope[chosen] = -np.inf
            if slope.max() <= cost:
                break
            found = None
            for k in np.argsort(-slope, kind="stable"):
                if slope[k] <= cost:
                    break
                got = self._em(p[:, [*chosen, int(k)]], c, n, np.append(share * 0.8, 0.2))
                if got[0] - best > cost and (found is None or got[0] > found[0]):
                    found = (*got, int(k))
            if found is None:
                break
            best, share, k = found
            chosen.append(k)
            mix = p[:, chosen] @ share
        order = sorted(range(len(chosen)), key=lambda i: (-share[i], self.languages[chosen[i]]))
        return [(self.languages[chosen[i]], float(share[i])) for i in order]

    def known(self, grams: np.ndarray, counts: np.ndarray, found: list[tuple[str, float]]) -> float:
        """Share of a bag of trigrams that its languages ``found`` explain; 1
        unless the log-likelihood gains more than the penalty by the uniform law."""
        share = np.array([s for _, s in found])
        own = self.prob[grams][:, [self.languages.index(a) for a, _ in found]]
        c = counts.astype(np.float64)
        n, any_gram = c.sum(), 1.0 / len(self.prob)
        mix, cost = own @ share, PENALTY * np.log(max(n, 2.0))
        if (c / mix).sum() * any_gram - n <= cost:  # as in ``mixture``, the slope bounds the gain
            return 1.0
        like, shares = self._em(np.column_stack((own, np.full(len(own), any_gram))), c, n, np.append(share * 0.8, 0.2))
        return float(1.0 - shares[-1]) if like - c @ np.log(mix) > cost else 1.0

    @staticmethod
    def _em(p: np.ndarray, c: np.ndarray, n: float, share: np.ndarray) -> tuple[float, np.ndarray]:
        for _ in range(EM_STEPS):
            mix = p @ share
            new = share * ((c / mix) @ p) / n
            done = np.abs(new - share).max() < EM_STOP
            share = new
            if done:
                break
        return float(c @ np.log(p @ share)), share

    def describe(self, text: str | None, letters: np.ndarray) -> tuple[str, float, list, float]:
        """(language, its share, all languages with shares, share of the text
        that they explain); ``und`` and 0 for a null text or one without a letter."""
        nothing = UNDETERMINED, 0.0, [], 0.0
        if not text:
            return nothing
        grams, counts = trigram_counts(text, letters)
        if not len(grams) or not self.languages:
            return nothing
        found = self.mixture(grams, counts)
        return found[0][0], min(1.0, found[0][1]), found, self.known(grams, counts, found)

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float, list]:
        """The first three of ``describe``."""
        return self.describe(text, letters)[:3]


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        per_language: int = PER_LANGUAGE) -> Model:
    """Trigram models from the labelled rows (null labels and texts are left
    out; no row: a model that answers ``und``). About ``per_language`` rows of
    each language are counted, the same ones in every run."""
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
                       F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("h")).where("lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((1 << BITS, 0)))
    limit = F.create_map([x for lang, n in sizes.items() for x in
                          (F.lit(lang), F.lit(min(1 << 30, int(per_language / n * (1 << 30)))))])
    sample = rows.where(F.col("h") <= limit[F.col("lang")]).where("text IS NOT NULL").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = letter_table(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams, counts = trigram_counts(text, letters)
                if lang not in sums:
                    sums[lang] = np.zeros(1 << BITS, dtype=np.int64)
                sums[lang][grams] += counts
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(s[at])],
                                             names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram bigint, n bigint") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    table = np.zeros((1 << BITS, len(languages)))
    if len(counted):
        table[counted["gram"].to_numpy(), counted["lang"].map(languages.index).to_numpy()] = counted["n"].to_numpy()
    table += SMOOTHING
    return Model(languages, table / table.sum(axis=0))


def predict_column(model: Model, text: Column) -> Column:
    """``struct(lang_pred, score, languages, known)`` of a text column."""
    shared = {"model": model}

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters, m = letter_table(), shared["model"]
        for s in batches:
            rows = [m.describe(t, letters) for t in s]
            yield pd.DataFrame({"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows],
                                "languages": [[{"lang": a, "share": b} for a, b in r[2]] for r in rows],
                                "known": [r[3] for r in rows]})
    return run.asNondeterministic()(text)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, lang_pred, score, languages, known``."""
    return docs.select(F.col(id_col), predict_column(model, F.col(text_col)).alias("_r")).select(id_col, "_r.*")
