import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash

from antecede.llm import conversations
from antecede.llm.conversations import MUST, Tables, damage, ending, initials, repair, step
from antecede.llm.queries import QUERIES, SQL

NAMES = {"u": "user", "a": "assistant"}


def follow(state, initial):
    """State after a turn, or None: states are what has been read of s?(ua)+."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def cheapest(rows):
    """Least (cost, initials, lines) over every way to edit the rows; rows are (role, text, must, cut)."""
    after = {"": (0, "", ()), "a": (0, "", ()), "u": (3, "I", ("assistant:",)), "s": (6, "II", ("user:", "assistant:"))}
    for role, text, must, cut in reversed(rows):
        best = {}
        for q in after:
            ways = [(4 + after[q][0], "D" + after[q][1], after[q][2])]
            if not must:
                q2 = follow(q, role[:1])
                if q2 is not None:
                    c, e, r = after[q2]
                    ways.append((c + 3 * cut, "K" + e, (f"{role}:{text}", *r)))
                for new in "ua":
                    q2 = follow(q, new)
                    if q2 is not None:
                        c, e, r = after[q2]
                        ways.append((c + 3 + 3 * cut, "R" + e, (f"{NAMES[new]}:{text}", *r)))
            best[q] = min(ways)
        for _ in range(3):  # inserts before the row
            for q in best:
                for new in "ua":
                    q2 = follow(q, new)
                    if q2 is not None:
                        c, e, r = best[q2]
                        best[q] = min(best[q], (c + 3, "I" + e, (f"{NAMES[new]}:", *r)))
        after = best
    return after[""]


def hashes(text):
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    one = xxhash.xxh64_intdigest(text.encode(), 42)
    second = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(b"second", 42))
    return signed(one), signed(second)


def brute(rows):
    """rows: (conv, turn, role, text) as they are given; the answer of repair()."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashes(r[2])))
        seen, marked = set(), []
        count = dict(blank=0, duplicate=0, truncated=0)
        for turn, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(marked)
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(df, ids=None):
    return {r.id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repair(df, ids).collect()}


@pytest.fixture(scope="module")
def turns(spark):
    """Rows with other columns whose names clash with those used inside."""

    def make(rows):
        full = [(*r, 5, "x", 1, 2, 3) for r in rows]
        return spark.createDataFrame(full, "conv_id bigint, turn bigint, role string, text string, pos int, conv string, copies int, chunk int, h1 int").repartition(3)

    return make


def talk(rng, conv, n, roles=("user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown", "sage")):
    texts = ["Yes.", "Why?", "cut off", "", " \n", None, "é. ", "a\nb!", "no. ", "Fine.", "Go!", "so"]
    return [(conv, rng.choice([k, k, k, k + 1, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"turn {k} of {conv}{rng.choice(['.', '!', ''])}")
            for k in range(n)]


def test_matches_brute_force(turns):
    rng = random.Random(4)
    rows = [r for c in range(150) for r in talk(rng, c, rng.randint(1, 12))]
    rows += talk(rng, None, 9) + [(900, None, None, None), (901, 1, "user", "x" * 300_000 + ".")] + [(902, 3, "user", "Same.")] * 50
    rows += [(903, k, "system", f"S{k}.") for k in range(6)] + [(904, k % 2, r, "T.") for k in range(3) for r in ("user", "assistant")]
    assert run(turns(rows)) == brute(rows)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_conversations_over_many_chunks(turns, monkeypatch, bits):
    monkeypatch.setattr(conversations, "CHUNK_BITS", bits)
    rng = random.Random(bits)
    rows = talk(rng, 1, 90) + [r for c in range(2, 12) for r in talk(rng, c, 8)] + [(50, 1, "user", "Same.")] * 9
    assert run(turns(rows)) == brute(rows)


def test_tables_agree_with_single_steps():
    t = Tables()
    rng = random.Random(2)
    assert len(t.vectors) < 400
    for _ in range(200):
        symbols = [rng.randrange(9) for _ in range(rng.randint(1, 20))]
        import numpy as np

        blocks = t.blocks(np.array(symbols))
        vectors, offset = t.backward(blocks, 0)
        slow = conversations.ENDS
        for s in reversed(symbols):
            slow = step(slow, s)
        assert tuple(v + offset for v in t.vectors[vectors[0]]) == slow
        plans, state = t.forward(blocks, vectors, 0)
        audit = initials("".join(plans) + ending(state))
        rows = [("sua?"[s // 2 % 4], "t", s == MUST, s < MUST and s % 2) for s in symbols]
        assert (slow[0], audit) == cheapest(rows)[:2]


def test_ids_without_rows_and_empty_tables(spark, turns):
    ids = spark.createDataFrame([(7,), (None,), (8,), (7,)], "conv_id bigint")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(turns([]), ids) == {7: nothing, 8: nothing, None: nothing} and run(turns([])) == {}
    got = run(turns([(8, 0, "user", "Hi."), (8, 1, "assistant", "Yes.")]), ids)
    assert got[8][6] == "KK" and got[7] == nothing


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_damage(turns):
    rng = random.Random(6)
    rows = [r for c in range(60) for r in talk(rng, c, 10)] + talk(rng, None, 5)
    got = sorted(map(tuple, damage(turns(rows)).collect()), key=str)
    assert got == sorted(damaged(rows), key=str)


def test_query_matches_brute_force_and_its_sql(spark, sf):
    import duckdb

    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows}} | brute(damaged(rows))
    columns = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, sf).select(*columns.split(", ")).collect()}
    assert got == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert {r[0]: r[1:] for r in con.sql(f"SELECT {columns} FROM ({SQL['op11_conversation_repair']})").fetchall()} == want
