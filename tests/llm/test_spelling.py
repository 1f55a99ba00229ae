import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from antecede.llm import spelling
from antecede.llm.queries import QUERIES, SQL
from antecede.llm.spelling import damaged_words, near_in_tile, near_words, variants, vocabulary


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, times=2):
    links = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if near(a, b):
            links[a].append(b)
            links[b].append(a)
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(links[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, counts, **more):
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    return sorted(tuple(r) for r in variants(words, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def words_like(rng, k, letters="abé", low=5, high=9):
    return {"".join(rng.choices(letters, k=rng.randint(low, high))): rng.choice([3, 3, 5, 6, 12, 25, 60]) for _ in range(k)}


def test_matches_brute_force(spark, monkeypatch):
    counts = words_like(random.Random(1), 400)
    assert run(spark, counts) == brute(counts)
    monkeypatch.setattr(spelling, "GROUP_WORDS", 4)  # every group is cut down to single places
    assert run(spark, counts) == brute(counts)


def test_hot_start_and_long_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP_WORDS", 16)
    monkeypatch.setattr(spelling, "GROUP_POINTS", 2000)
    rng = random.Random(3)
    counts = {"prefix" + w: n for w, n in words_like(rng, 150, "xyz", 3, 6).items()}
    long = "".join(rng.choices("pqr", k=3000))
    counts |= {long: 40, long[:1500] + long[1501:]: 9, long[:-1] + "z": 3, "z" + long: 3, long + "zz": 3, "漢字漢字漢": 8, "漢字漢字字": 3, "😀bcde": 3, "abcde": 7}
    assert run(spark, counts) == brute(counts)


def test_tiles_hold_groups_of_one_kind():
    rng = random.Random(8)
    words = list(words_like(rng, 120, "ab", 5, 6).items())
    got = Counter()
    for p, q in ((0, 3), (3, 6)):
        for w, n, _, _ in near_in_tile([(n, w) for w, n in words], 6, p, q):
            got[w] += n
    want = Counter()
    for (a, _), (b, _) in combinations(words, 2):
        if near(a, b) and max(len(a), len(b)) == 6:
            want.update((a, b))
    assert got == want


def test_chain_is_followed_and_ties_go_to_the_first(spark):
    counts = {"aaaaa": 100, "aaaab": 50, "aaabb": 25, "aabbb": 12, "abbbb": 6, "bbbbb": 3, "ccccc": 3, "ccccd": 6, "cccce": 6, "lonely": 3}
    rows = {r[0]: r for r in run(spark, counts)}
    assert rows["bbbbb"][1:3] == ("abbbb", "aaaaa") and rows["ccccc"][1] == "ccccd" and rows["lonely"] == ("lonely", None, "lonely", 3, 0, None)
    assert run(spark, {}) == []
    with pytest.raises(ValueError):
        run(spark, counts, times=1)


def brute_words(rows):
    out = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 5:
                out[w] += 1
    return out


def test_words_are_damaged_as_stated(frame, cases):
    rng = random.Random(5)
    pool = ["House", "HOUSES", "Élan", "élans", "naïve", "x" * 300, "don't", "abcd", "abcde", "straße", "×÷×÷×"]
    rows = cases + [(i, " ".join(rng.choices(pool, k=rng.randint(0, 400)))) for i in range(100, 300)]
    got = {r.word: r.n for r in vocabulary(damaged_words(frame(rows)), 3).collect()}
    want = {w: n for w, n in brute_words(rows).items() if n >= 3}
    assert got == want and "hous" not in want and any(len(w) == 299 for w in brute_words(rows))
    assert near_words(vocabulary(damaged_words(frame([])))).count() == 0


def test_query_matches_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({SQL['op13_spelling']})").fetchall()
    got = QUERIES["op13_spelling"](spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and any(r[1] for r in want)
