"""Trained operators: held-out accuracy, brute-force twins of their counts, edge rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import crf, langmix, nbsvm
from sluice.llm.common import held_out

EDGE = [None, "", " \n\t", "12 34 !?", "a", "short text", "the end\n" * 20000]
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "eng", "ich", "und"], "cc": ["ção", "lhe", "que", "em"]}


def sentence(rng, lang, n=12):
    words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def corpus(seed=0, n=240):
    """(id, text, lang, quality): good prose in lines, and four kinds of junk."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        lines = [sentence(rng, lang, rng.randint(5, 15)) for _ in range(rng.randint(2, 6))]
        good = int(rng.random() < 0.7)
        if not good:
            kind = i % 4
            for k in range(1, len(lines)):
                w = lines[k].split()
                lines[k] = [" ".join(x + "###" for x in w), " | ".join(w) + " |", " ".join(x.upper() + "!!" for x in w),
                            " ".join(x for x in w for _ in range(6))][kind]
        rows.append((i, "\n".join(lines), lang, good))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang, _ in rows],
                                 "doc_id long, text string, lang string, _r string, score int")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows] + [(None, 1), (0, None), (10 ** 6, 0)], "doc_id long, quality int")
    return rows, docs.cache(), labels.cache()


def edges(spark):
    return spark.createDataFrame([(i if i else None, t, None, "s", 1) for i, t in enumerate(EDGE)] * 2,
                                 "doc_id long, text string, lang string, _r string, score int")


def test_held_out_rule(spark):
    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)


def test_nbsvm_held_out_accuracy(spark, frames):
    rows, docs, labels = frames
    model = nbsvm.fit(docs.where(~held_out(F.col("doc_id"))), labels)
    got = {r["doc_id"]: r for r in nbsvm.score(docs, model).collect()}
    test = [(i, q) for i, _, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == q for i, q in test) >= 0.95 * len(test)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    out = nbsvm.score(edges(spark), model).collect()
    assert len(out) == 2 * len(EDGE) and all(0 <= r["score"] <= 1 for r in out)
    assert nbsvm.score(docs.limit(0), model).count() == 0


def test_nbsvm_without_labels(spark, frames):
    _, docs, labels = frames
    model = nbsvm.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in nbsvm.score(docs, model).collect()} == {1}


def test_dual_descent_meets_its_conditions():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 300, size=20)) for _ in range(200)]
    y = np.where([(r < 100).sum() > 6 for r in rows], 1.0, -1.0)
    ratio = nbsvm.log_count_ratio(rows, y)
    w, bias = nbsvm.dual_descent(rows, y, ratio, np.full(len(y), 10.0))
    hits = sum(np.sign((ratio[r] / np.linalg.norm(ratio[r])) @ w[r] + bias) == t for r, t in zip(rows, y))
    assert hits >= 0.95 * len(y)


def test_indicators_do_not_depend_on_chunks(monkeypatch):
    text = "\n".join(t for _, t, _, _ in corpus(3, 30))
    whole = nbsvm.indicators(text)
    monkeypatch.setattr(nbsvm, "CHUNK", 17)
    assert np.array_equal(whole, nbsvm.indicators(text))


def test_language_accuracy_and_shares(spark, frames):
    rows, docs, _ = frames
    model = langmix.fit(docs.where(~held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in langmix.identify(docs, model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in rows) >= 0.98 * len(rows)
    letters, rng = langmix.letter_table(), random.Random(1)
    mixed = " ".join(sentence(rng, "aa", 40) for _ in range(3)) + " " + " ".join(sentence(rng, "bb", 20) for _ in range(2))
    lang, score, shares = model.predict(mixed, letters)
    assert lang in ("aa", "bb") and {a for a, _ in shares} == {"aa", "bb"} and 0.5 < score < 0.9
    assert abs(sum(s for _, s in shares) - 1) < 1e-6
    out = {r["doc_id"]: r for r in langmix.identify(edges(spark), model).collect()}
    assert [out[i]["lang_pred"] for i in (None, 1, 2, 3)] == ["und"] * 4 and out[6]["lang_pred"] in ("aa", "bb", "cc")


def test_language_without_labels(spark, frames):
    model = langmix.fit(edges(spark))
    assert {r["lang_pred"] for r in langmix.identify(edges(spark), model).collect()} == {"und"}
    assert langmix.identify(edges(spark).limit(0), model).count() == 0


def test_trigram_counts_do_not_depend_on_chunks(monkeypatch):
    letters, text = langmix.letter_table(), "Ünï 12 code\U00010400 word, word " * 50
    whole = langmix.trigram_counts(text, letters)
    monkeypatch.setattr(langmix, "CHUNK", 7)
    part = langmix.trigram_counts(text, letters)
    assert np.array_equal(whole[0], part[0]) and np.array_equal(whole[1], part[1])


def plain_base(text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    marks = set()
    count = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    for i in range(len(words) - 4):
        if count[tuple(words[i:i + 5])] > 1:
            marks.update(range(i, i + 5))
    lines, dup = [], 0
    for line in text.split("\n"):
        dup += line in lines and bool(line.strip(" \t\n\x0b\x0c\r"))
        lines.append(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marks)


def test_base_counts(spark, frames):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("a b c d #e|".split(), k=rng.randint(0, 60))).replace("c d", "c\nd").replace("a b", "a b\n\n")
             for _ in range(300)] + EDGE[:6]
    for t in texts:
        assert crf.base_counts(t)[1:] == plain_base(t), t


def test_line_labels_keep_good_documents(spark, frames):
    rows, docs, labels = frames
    field = crf.fit(docs, labels)
    got = {r["doc_id"]: r for r in crf.judge(docs, field).collect()}
    clean = [got[i] for i, _, _, q in rows if q and not got[i]["base_failed"]]
    junk = [got[i] for i, t, _, q in rows if not q and not got[i]["base_failed"] and t.count("\n") > 2]
    assert all(r["kept"] for r in clean) and sum(r["kept"] for r in junk) <= 0.1 * len(junk)
    out = {r["doc_id"]: r for r in crf.judge(edges(spark), field).collect()}
    assert not any(out[i]["kept"] for i in (None, 1, 2, 3, 4, 5)) and out[6]["base_failed"]
    assert crf.judge(docs.limit(0), field).count() == 0


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 8):
        field = crf.Field(rng.standard_normal((crf.N_FEATURES, 2)), rng.standard_normal((2, 2)), rng.standard_normal(2))
        x = rng.random((n, crf.N_FEATURES))
        e, best, path = x @ field.emit, -np.inf, None
        for p in range(1 << n):
            s = [(p >> i) & 1 for i in range(n)]
            score = field.start[s[0]] + sum(e[i, s[i]] for i in range(n)) + sum(field.move[a, b] for a, b in zip(s, s[1:]))
            if score > best:
                best, path = score, s
        assert field.decode(x).tolist() == path


def test_training_gradient_reaches_likelihood():
    rng = np.random.default_rng(3)
    numbers = np.zeros((6, 11))
    good = [(numbers + [0, 0, 0.02, 0, 0, 0, 8, 1, 1, 0, 0], 1) for _ in range(20)]
    bad = [(numbers + [rng.random() * 0.2 + 0.5, 0, 0.5, 0, 0, 0, 8, 0, 1, 0, 0], 0) for _ in range(20)]
    field = crf.train(good + bad)
    assert field.decode(crf.featurize(good[0][0])).all() and not field.decode(crf.featurize(bad[0][0])).any()
    assert crf.train([]).decode(crf.featurize(numbers)).all()


def test_mixed_texts_get_both_labels(spark, frames):
    """Transitions between the states are learned, so the content share decides."""
    rows, docs, labels = frames
    field = crf.fit(docs, labels)
    judged = {r["doc_id"]: r for r in crf.judge(docs, field).collect()}
    good = [t for i, t, _, q in rows if q and judged[i]["kept"] and t.count("\n") > 3]
    bad = [t for i, t, _, q in rows if not q and not judged[i]["kept"] and not judged[i]["base_failed"] and t.count("\n") > 3]
    rng, mixed = random.Random(6), []
    for _ in range(60):
        a, b = rng.choice(good).split("\n"), rng.choice(bad).split("\n")
        mixed.append("\n".join(a[:rng.randint(2, len(a))] + b[1:] + a[-2:]))
    got = crf.judge(spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string"), field).collect()
    both = [r for r in got if 0 < r["n_content_lines"] < r["n_lines"]]
    assert len(both) >= 0.9 * len(got)
    assert len({r["kept"] for r in both if not r["base_failed"]}) == 2 or all(r["base_failed"] for r in both)


def test_joined_sequences_change_state():
    lines = [(np.arange(55.0).reshape(5, 11) + k, k % 2) for k in range(8)]
    found = crf.joined(lines)
    assert len(found) == 4 and all(len(x) == len(y) and 0 < y.sum() < len(y) for x, y in found)
    assert crf.joined(lines[::2]) == [] and all(np.array_equal(a[0], b[0]) for a, b in zip(found, crf.joined(lines)))


def test_dual_descent_reaches_the_dual_optimum():
    """The dual value against projected gradient ascent on the whole problem, and the gap to the primal value."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 60, size=12)) for _ in range(60)]
    y = np.where([(r < 20).sum() > 3 for r in rows], 1.0, -1.0)
    y[:6] *= -1  # not separable
    ratio, cost = nbsvm.log_count_ratio(rows, y), np.where(y > 0, 0.7, 1.3)
    w, bias = nbsvm.dual_descent(rows, y, ratio, cost)
    x = np.zeros((len(rows), 61))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, 60] = 1.0
    q = (x @ x.T) * np.outer(y, y)
    alpha, step = np.zeros(len(rows)), 1.0 / np.linalg.eigvalsh(q)[-1]
    for _ in range(100_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, cost)
    best = alpha.sum() - 0.5 * alpha @ q @ alpha
    found = np.append(w[:60], bias)
    primal = 0.5 * found @ found + (cost * np.maximum(0, 1 - y * (x @ found))).sum()
    assert best - 1e-9 <= primal <= best + 0.01 * abs(best)
    assert np.allclose(found, (alpha * y) @ x, atol=0.05)


def test_language_set_against_every_subset():
    """The penalised likelihood of the chosen set against that of all sets of up to four languages."""
    from itertools import combinations
    rng = np.random.default_rng(8)
    size, names = 400, ["aa", "bb", "cc", "dd"]
    table = np.stack([rng.gamma(0.3, size=size) + 1e-3 for _ in names], axis=1)
    model = langmix.Model(names, table / table.sum(axis=0))
    for shares in ([1, 0, 0, 0], [0.6, 0.4, 0, 0], [0.4, 0.3, 0.3, 0], [0.25] * 4, [0, 0, 0.97, 0.03]):
        drawn = rng.multinomial(4000, model.prob @ np.array(shares))
        grams = np.flatnonzero(drawn)
        p, c = model.prob[grams], drawn[grams].astype(float)
        cost = langmix.PENALTY * np.log(c.sum())

        def value(chosen):
            s = np.full(len(chosen), 1 / len(chosen))
            for _ in range(3000):
                s = s * ((c / (p[:, chosen] @ s)) @ p[:, chosen]) / c.sum()
            return c @ np.log(p[:, chosen] @ s) - cost * (len(chosen) - 1), s
        best = max(((*value(list(k)), k) for n in range(1, 5) for k in combinations(range(4), n)), key=lambda v: v[0])
        got = dict(model.mixture(grams, drawn[grams]))
        assert set(got) == {names[k] for k in best[2]}
        assert all(abs(got[names[k]] - s) < 0.02 for k, s in zip(best[2], best[1]))
