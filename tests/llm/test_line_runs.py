import random
from collections import Counter

from antecede.llm.line_runs import LineRuns, drop_common_lines


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, least):
    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if counts[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def run(docs, **more):
    return sorted(((r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in drop_common_lines(docs, **more).collect()), key=str)


def test_matches_brute_force(frame, cases):
    rng = random.Random(2)
    pool = ["Share This", " share this\t", "ÉTÉ", "été", "x", "", " ", "Read more…", "\x0b tab"] + [f"line {k}" for k in range(30)]
    rows = cases + [(i + 50, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(60)]
    assert run(frame(rows), min_docs=10) == brute(rows, 10)
    assert run(frame(rows), min_docs=3, batches=7) == brute(rows, 3)
    assert drop_common_lines(frame([])).count() == 0


def test_rows_keep_their_columns(frame):
    out = drop_common_lines(frame([(1, "a")])).first()
    assert out.row.row == "x" and out.row.n == 1 and out.kept == "a"


def test_runs_are_levelled_and_counts_add_up(spark):
    runs = LineRuns(spark, enough=5, fan=2)
    total = Counter()
    rng = random.Random(6)
    for _ in range(7):
        batch = [(rng.randint(0, 9), 0) for _ in range(8)]
        total.update(h for h, _ in batch)
        runs.add(spark.createDataFrame(batch, "h1 bigint, h2 bigint"))
        assert all(len(level) < 2 for level in runs.levels)
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    assert {r.h1 for r in runs.frequent().collect()} == {h for h, n in total.items() if n >= 5}


def test_saturated_keys_are_not_added_again(spark):
    runs = LineRuns(spark, enough=3, fan=10)
    for _ in range(3):
        runs.add(spark.createDataFrame([(1, 1)] * 4 + [(2, 2)], "h1 bigint, h2 bigint"))
    assert sorted((r.h1, r.n) for r in runs.read().collect()) == [(1, 4), (2, 1), (2, 1), (2, 1)]
