import os
import random
import re

import duckdb
import pytest

from sluice.llm import licenses as L
from sluice.llm import queries

SF = "/root/testdata/sf0.001"
KNOWN = [(n, L.template_bigrams(t)) for n, t in L.TEMPLATES]


def words_of(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def plain_matches(text, known=KNOWN, t=L.THRESHOLD):
    """Every run of the text against every template, then one winner a place."""
    w = words_of(text)
    g = [f"{a} {b}" for a, b in zip(w, w[1:])]
    runs = []
    for k, (name, grams) in enumerate(known):
        grams = set(grams)
        for s in range(len(g)):
            if g[s] not in grams or (s and g[s - 1] in grams):
                continue
            seen, both, best = set(), 0, None
            for e in range(s, len(g)):
                if g[e] not in seen:
                    seen.add(g[e])
                    both += g[e] in grams
                    score = 2 * both / (len(seen) + len(grams))
                    if score >= t and (best is None or score > best[0]):
                        best = (score, len(seen), s, e + 1)
            if best:
                runs.append((-best[0], -best[1], s, k, name, best[3]))
    out = []
    for r in sorted(runs):
        if not any(a[2] <= r[5] and r[2] <= a[5] for a in out):
            out.append(r)
    return sorted((r[4], r[2], r[5] - r[2] + 1, -r[0]) for r in out)


def texts(seed=1):
    rng = random.Random(seed)
    prose = "here is the software license for any purpose with version three under general terms a the of".split()
    out = [None, "", " \n\n ", "word", "MIT", "x\n" * 5000]
    for _, template in L.TEMPLATES:
        words = template.split()
        for change in (0, 0.05, 0.15, 0.3):
            own = [rng.choice(prose) if rng.random() < change else w for w in words]
            own = [w for x in own for w in ([x, rng.choice(prose)] if rng.random() < change / 3 else [x])]
            sep = rng.choice([" ", "\n", "  ", "\n\n"])
            body = sep.join(own)
            out.append(rng.choice(["", "Some prose of the author.\n", "Intro under the\n \n"]) + body + rng.choice(["", "\nMore prose here.", " license and\n\nEnd"]))
    for _ in range(20):  # several notices in one text, side by side or apart
        parts = [rng.choice(L.TEMPLATES)[1] for _ in range(rng.randint(2, 5))]
        out.append(rng.choice([" ", "\n", " some words between them, under the sun "]).join(parts))
    return out


def found(df, key="doc_id"):
    got = {}
    for r in df.collect():
        got.setdefault(r[key], []).append((r["license"], r["place"], r["n_words"], r["score"]))
    return {k: sorted(v) for k, v in got.items()}


def test_scan_against_brute_force(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, n int")
    got = found(L.scan(docs))
    want = {i: m for i, t, _, _ in rows if (m := plain_matches(t))}
    assert got == want
    assert len(want) > 100


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Licensed under CC BY 4.0")],
                                 "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["license"], r["place"], r["n_words"], r["score"]) for r in L.scan(docs).collect())
    assert got == [("1", "MIT", 0, 5, 1.0)] * 2 + [("None", "CC-BY-4.0", 0, 6, 1.0)]
    assert L.scan(docs.limit(0)).count() == 0
    assert L.scan(docs, templates=[]).count() == 0


def test_anchors_are_necessary():
    words, rng = set(L.anchors(KNOWN, 0.8)), random.Random(2)
    for _, grams in KNOWN:
        need = L._bounds(len(grams), 0.8)[2]
        for _ in range(50):
            assert words & {w for g in rng.sample(grams, need) for w in g.split()}


def test_one_licence_for_a_place(spark):
    """Notices that differ by a word from those of other licences."""
    lines = {"GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
             "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
             "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
             "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
             "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
             "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
             "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."}
    around = "plain words of a story that goes on and on " * 20
    rows = [(n, f"{around}\n{t}\n{around}") for n, t in lines.items()] + [(f"{n} whole", t) for n, t in L.TEMPLATES]
    got = found(L.scan(spark.createDataFrame(rows, "doc_id string, text string")))
    for n, _ in rows:
        assert [x[0] for x in got[n]] == [n.split(" ")[0]] * len(got[n]), n


def test_runs_of_any_length_and_all_of_them(spark):
    prose = "\n\n".join(" ".join(f"word{i * j % 97}" for j in range(60)) + " under the terms of the software" for i in range(1, 30))
    mit = next(t for n, t in L.TEMPLATES if n == "MIT" and len(t) > 500).split()
    published = f"Copyright (c) 2020 Some Body\n\n{' '.join(mit[:60])}\n\n{' '.join(mit[60:90])}\n\n{' '.join(mit[90:])}"
    rows = [(1, f"{prose}\n\n{published}\n\n{prose}"), (2, f"{prose} This tool, released under the MIT License, parses logs. {prose}"),
            (3, "released under " + "the " * 500 + "mit license"), (4, prose), (5, "the " * 100000),
            (6, " ".join(f"Released under the MIT License. Item{k} is a part that has words of its own, number{k}." for k in range(300)))]
    got = found(L.scan(spark.createDataFrame(rows, "doc_id int, text string")))
    assert got == {i: m for i, t in rows[:4] + rows[5:] if (m := plain_matches(t))}
    assert [(x[0], x[3] > 0.95) for x in got[1]] == [("MIT", True)] and got[2][0][2:] == (5, 1.0)
    assert got[3][0][:3] == ("MIT", 0, 504) and len(got[6]) == 300 and 5 not in got


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_query_equals_its_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, license, place, n_words, score FROM ({queries.ORACLES['op1_license_dice']}) q").fetchall()
    got = queries.QUERIES["op1_license_dice"](spark, SF).select("doc_id", "license", "place", "n_words", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
    plain = [(i, *m) for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall() for m in plain_matches(t)]
    assert sorted(want) == sorted(plain)
    # the twin on the look-alike and edited texts as well
    import pandas as pd
    own = pd.DataFrame({"doc_id": range(len(texts(5))), "text": texts(5)})  # noqa: F841
    con.execute("CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM own")
    twin = con.execute(f"SELECT doc_id, license, place, n_words, score FROM ({queries.ORACLES['op1_license_dice']}) q").fetchall()
    assert sorted(twin) == sorted((i, *m) for i, t in enumerate(texts(5)) for m in plain_matches(t))
