import hashlib
import os
import random
import re

import duckdb
import pytest

from sluice.llm import decontam, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items, window):
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        size = min(window, len(w))
        grams = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in grams:
                hit.update(range(i, i + size))
                found.add("" if item is None else str(item))
    return words, hit, sorted(found)


def check(row, text, items, window):
    words, hit, found = plain(text, items, window)
    assert (row["n_words"], row["n_hit"], row["n_items"]) == (len(words), len(hit), len(found)), (text, items)
    assert row["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    assert row["contaminated"] == bool(hit) and list(row["items"]) == found
    assert {i for s in row["spans"] for i in range(s["start"], s["stop"])} == hit
    raw = (text or "").encode()
    for s in row["spans"]:
        assert words_of(raw[s["first_byte"]:s["last_byte"]].decode()) == words[s["start"]:s["stop"]]


def test_automaton_equals_plain_on_small_alphabets():
    rng = random.Random(1)
    for n in range(1500):
        window = rng.randint(2, 5)
        make = lambda most: " ".join(rng.choices(["a", "B", "c", "é", "-"][:rng.randint(1, 5)], k=rng.randint(0, most)))
        items = [(rng.randint(0, 6), make(12)) for _ in range(rng.randint(0, 5))]
        pieces = [(str(i), [w.encode() for w in words_of(t)]) for i, t in items]
        machine = decontam.Automaton.unpacked(decontam.Automaton(pieces, window).packed())
        assert len(machine.link) <= 2 * sum(len(w) for _, w in pieces) + 1
        text = make(40)
        words, hit, found = plain(text, items, window)
        n_words, n_hit, spans, got = machine.scan(text)
        assert (n_words, n_hit, got) == (len(words), len(hit), found), (text, items, window)
        assert {i for s in spans for i in range(s["start"], s["stop"])} == hit


@pytest.mark.parametrize("part_words, piece_words", [(200_000, 4096), (40, 7), (5, 3)])
def test_parts_and_pieces(spark, part_words, piece_words):
    rng = random.Random(part_words)
    vocabulary = [f"w{k}" for k in range(40)] + ["né", "日本"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 12, 30, 70])))) for i in range(12)]
    items += [(None, "lone item"), (3, items[3][1]), (40, None), (41, "..."), (42, items[5][1])]
    docs = [(0, None), (1, ""), (2, "lone item, LONE\nitem"), (None, "lone ite m")]
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 20)))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, len(w))
            parts += [", ".join(w[a:a + rng.randint(0, 40)]).upper(), rng.choice(["", " - x ", "w1"])]
        docs.append((10 + i, " ".join(parts)))
    docs += [(80, items[4][1] + " "), (80, items[4][1] + " "), (81, "w1 " * 100000 + (items[9][1]))]
    d = spark.createDataFrame([(k, i, t, 1, "m") for k, (i, t) in enumerate(docs)], "k int, doc_id long, text string, _place int, spans string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = decontam.flags(d, b, id_col="k", window=5, part_words=part_words, piece_words=piece_words).collect()
    assert sorted(r["k"] for r in got) == list(range(len(docs)))
    for r in got:
        check(r, docs[r["k"]][1], items, 5)


def test_clean_and_empty(spark):
    item = "one two three four five six seven eight nine ten eleven"
    around = "some words before it " * 5
    d = spark.createDataFrame([(1, f"{around}One, two three four five six seven eight nine TEN eleven! after", "a"),
                               (2, item, "b"), (3, None, "c"), (4, around, "d"), (5, "", "e")], "doc_id long, text string, _matched string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.clean(d, b).collect()}
    assert sorted(got) == [1, 3, 4, 5] and got[1]["text"] == f"{around}! after" and got[3]["text"] is None
    assert got[4]["text"] == around and got[1]["_matched"] == "a"
    assert decontam.clean(d, b, least_longest=12, most_coverage=1.0).exceptAll(d).count() == 0
    assert decontam.flags(d.limit(0), b).count() == 0
    none = decontam.flags(d, b.limit(0)).collect()
    assert len(none) == 5 and not any(r["contaminated"] for r in none) and {r["n_words"] for r in none} == {32, 11, 0, 20}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    names = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    want = con.execute(f"SELECT {names} FROM ({queries.ORACLES['op12_decontam_automaton']}) q").fetchall()
    got = queries.QUERIES["op12_decontam_automaton"](spark, SF).select(*names.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r[5] for r in want)
