import random
from fractions import Fraction

from pyspark.sql import functions as F

from sluice.llm import mixing

SCHEMA = "doc_id long, text string, source string, _plan string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def plain_targets(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not full:
            target.update({s: level * weight[s] for s in free})
            break
        for s in full:
            target[s] = Fraction(2 * sizes[s])
        left -= sum(target[s] for s in full)
        free -= full
    return sizes, target


def documents(seed=1, n=400):
    rng = random.Random(seed)
    names = ["a"] * 8 + ["b", "c", "é", "Z", None, "tiny"]
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(names)) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "empty"), (n + 2, "\t \n", "empty"), (7, "again", "b"), (7, "again", "b"),
                   (None, "no id", "c"), (n + 3, "v " * 30000, "big")]


def test_targets_and_takes(spark):
    rows = documents()
    sizes, target = plain_targets(rows)
    got = mixing.mix(frame(spark, rows), prefix="m_").collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["m_size"] == len((r["text"] or "").encode().split())
        assert r["m_source_size"] == sizes[r["source"]] and 0 <= r["m_copies"] <= 2
        assert abs(r["m_target"] - float(target[r["source"]])) <= 1e-6 * max(1.0, r["m_target"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["m_size"] * r["m_copies"]
    for s in sizes:  # half the largest document is the most a whole-document mix can be off by
        largest = max(len((t or "").encode().split()) for _, t, x in rows if x == s)
        assert abs(taken[s] - target[s]) <= max(1, largest / 2), s
    assert abs(taken["a"] - target["a"]) <= 0.01 * target["a"]


def test_reruns_and_partitions_agree(spark):
    rows = documents(2)
    once = {(r["doc_id"], r["text"], r["source"]): r["m_copies"] for r in mixing.mix(frame(spark, rows), prefix="m_").collect()}
    again = mixing.mix(frame(spark, rows[::-1]).repartition(5), prefix="m_").collect()
    assert once == {(r["doc_id"], r["text"], r["source"]): r["m_copies"] for r in again}


def test_sample_emits_copies(spark):
    docs = frame(spark, documents(3))
    copies = mixing.mix(docs, prefix="m_").agg(F.sum("m_copies")).first()[0]
    mixed = mixing.sample(docs)
    assert mixed.columns == docs.columns and mixed.count() == copies


def test_empty_and_wordless(spark):
    assert mixing.mix(frame(spark, []).limit(0)).count() == 0
    got = mixing.mix(frame(spark, [(1, None, None), (2, "", "s")]), prefix="m_").collect()
    assert all(r["m_size"] == 0 and r["m_target"] == 0 for r in got)
    one = mixing.mix(frame(spark, [(1, "a b", None)]), prefix="m_").first()
    assert (one["m_size"], one["m_target"]) == (2, 3.0)


def plain_takes(rows):
    """First fit in digest order over documents of each source, then the nearest one."""
    import hashlib
    sizes, target = plain_targets(rows)
    out = {}
    for s in sizes:
        extra = float(target[s])
        whole = min(int(extra // sizes[s]), 2) if sizes[s] else 0
        rest = extra - whole * sizes[s] if whole < 2 else 0.0
        docs = sorted((hashlib.md5(f"mix-1:{i}".encode()).hexdigest(), len((t or "").encode().split()), i) for i, t, x in rows if x == s)
        more, begun = set(), rest > 0
        for _, n, i in docs:
            if n <= rest and begun:
                rest, _ = rest - n, more.add(i)
        left = [(abs(n - rest), g, i) for g, n, i in docs if i not in more and n > 0 and abs(n - rest) < rest] if begun else []
        more |= {min(left)[2]} if left else set()
        out.update({i: n * (whole + (i in more)) for _, n, i in docs})
    return out


def test_documents_that_do_not_fit_are_passed_over(spark):
    rng = random.Random(8)
    rows = [(k, "w " * 100, "a") for k in range(100)] + [(1000 + k, "v " * rng.choice([20000, 9000, 3000, 17]), "b") for k in range(40)]
    rows += [(2000, "u " * 20000, "a"), (2001, "u " * 15000, "a"), (3000, "x " * 60000, "c")]
    got = {r["doc_id"]: r["m_size"] * r["m_copies"] for r in mixing.mix(frame(spark, rows), prefix="m_").collect()}
    assert got == plain_takes(rows)
    _, target = plain_targets(rows)
    for s in "ab":
        smallest = min(len(t.split()) for _, t, x in rows if x == s)
        taken = sum(got[i] for i, _, x in rows if x == s)
        assert abs(taken - target[s]) <= max(smallest, 0.02 * float(target[s])), s


def test_query_equals_its_sql_on_skewed_sources(spark):
    import duckdb
    import pandas as pd

    from sluice.llm import queries
    rng = random.Random(9)
    rows = [(k, "w " * rng.choice([1, 5, 40, 300, 5000]), rng.choice(["a", "a", "b", None])) for k in range(250)] + [(7, "w " * 3, "a")]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"])  # noqa: F841
    want = duckdb.sql(f"SELECT doc_id, size, taken FROM ({queries.OP3_SQL}) q").fetchall()
    got = mixing.mix(frame(spark, rows), prefix="m_").select("doc_id", "m_size", F.col("m_size") * F.col("m_copies")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
