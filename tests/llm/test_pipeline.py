import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from antecede.llm.store import stored, table
from tests.llm.test_simhash import fingerprint, roots


@pytest.fixture(scope="module")
def steps(spark, sf):
    """Input and output of every stage."""
    docs, out = table(spark, sf, "documents"), {}
    for name, stage in pipeline.STAGES:
        after = stored(stage(spark, docs, sf), name)
        out[name] = ({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}, docs.columns, after.columns)
        docs = after
    return out


def test_columns_and_order(steps):
    assert list(steps) == ["language", "line_dedup", "near_dedup", "decontaminate", "mix"]
    for name, (_, _, before, after) in steps.items():
        assert after == (before if name != "mix" else [*before, "copies"])


def test_language_keeps_clean_documents(steps):
    before, after, *_ = steps["language"]
    assert all(not re.search(r"[^\W\d_]", before[i].text or "") for i in set(before) - set(after))


def test_line_dedup(steps):
    before, after, *_ = steps["line_dedup"]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    counts = Counter(k for r in before.values() for k in {key(x) for x in r.text.split("\n")} if k)
    for i, r in before.items():
        assert after[i].text == "\n".join(x for x in r.text.split("\n") if counts[key(x)] < 10)
        assert after[i].n_chars == len(after[i].text) and after[i].source == r.source
    assert set(after) == set(before)


def test_near_dedup_keeps_one_of_each_group(steps):
    before, after, *_ = steps["near_dedup"]
    fps = {i: fingerprint(r.text) for i, r in before.items()}
    root = roots(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    assert set(after) == set(root.values())


def test_decontamination(steps, spark, sf):
    before, after, *_ = steps["decontaminate"]
    items = [r.text.lower() for r in table(spark, sf, "benchmark").collect()]
    holds = {i for i, r in before.items() if any(t in r.text.lower() for t in items)}
    assert set(before) - set(after) == holds


def test_mix(steps, spark, sf):
    before, after, *_ = steps["mix"]
    assert set(after) <= set(before) and all(1 <= r.copies <= 2 for r in after.values())
    assert {(r.doc_id, r.copies) for r in pipeline.run(spark, sf).collect()} == {(r.doc_id, r.copies) for r in after.values()}


def test_odd_rows_pass_every_stage(spark, sf):
    rows = [(1, None, None, None, 1), (2, "", "en", "a", 0), (3, "the words of this text", "en", "a", 9), (3, "the words of this text", "en", "a", 9),
            (None, "eine zeile ohne nummer", "de", None, 3), (4, "!!", "en", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
    assert {r.doc_id for r in docs.collect()} <= {3, None}
    empty = docs.select("doc_id", "text", "lang", "source", "n_chars").where("false")
    assert all(stage(spark, empty, sf).count() == 0 for _, stage in pipeline.STAGES)


def test_mix_takes_rows_not_ids(spark, sf):
    """Rows without an id, and those that share one, are drawn one by one."""
    rows = [(None if k % 2 else 7, "w " * 10, "en", "abc"[k % 3], k) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = pipeline.mixed(spark, docs, sf).collect()
    assert len({r.n_chars for r in got}) == len(got)
    taken = {s: sum(r.copies for r in got if r.source == s) for s in "abc"}
    assert taken == pytest.approx({"a": 400, "b": 5000 / 30, "c": 10000 / 30}, abs=1)
