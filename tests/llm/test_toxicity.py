import numpy as np
from pyspark.sql import functions as F

from antecede.llm import toxicity
from antecede.llm.store import table


def test_held_out_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    grades = labels.select("doc_id", toxicity.grade_of(F.col("t"), F.col("q")).alias("grade"))
    model = toxicity.fit(docs, grades.where("doc_id % 3 > 0"), top=2)
    assert model.cuts[0] < model.cuts[1]
    truth = {r.doc_id: r.t for r in labels.where("doc_id % 3 = 0").collect()}
    got = {r.id: r for r in toxicity.score(docs, model).collect() if r.id in truth}
    bad = [got[i].severity for i, t in truth.items() if t]
    good = [got[i].severity for i, t in truth.items() if not t]
    above = np.mean([[b > g for g in good] for b in bad])
    assert above >= 0.85
    assert np.mean([got[i].toxic for i, t in truth.items() if not t]) <= 0.02


def test_grades_are_learnt_in_order():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 600)
    bucket = np.column_stack([rng.integers(10, 400, 600), np.where(grade > 0, 1, 2), np.where(grade > 1, 3, 4)]).reshape(-1)
    model = toxicity.fit_rows(bucket, np.ones(1800), np.arange(0, 1801, 3), grade, 2)
    over = model.exceed(bucket, np.ones(1800), np.arange(0, 1801, 3))
    severity = over.sum(1)
    assert model.cuts[0] < model.cuts[1] and (over[:, 0] >= over[:, 1]).all()
    assert [round(severity[grade == g].mean()) for g in range(3)] == [0, 1, 2]


def test_cases(frame, cases, spark):
    none = toxicity.fit(frame(cases), spark.createDataFrame([], "doc_id int, grade int"), top=2)
    assert none is None
    rows = toxicity.score(frame(cases), none).collect()
    assert len(rows) == len(cases) and {(r.severity, r.grade, r.toxic) for r in rows} == {(0.0, 0, False)}
    model = toxicity.OrdinalModel(np.ones(toxicity.BUCKETS), np.array([0.1, 5.0]))
    got = toxicity.score(frame(cases), model).collect()
    assert {r.id for r in got if not r.toxic} == {1, 2, 3, 7}
    assert toxicity.score(frame([]), model).count() == 0


def test_words_are_hashed_per_text():
    data = "One two ONE|drei,é".encode()
    bucket, value, offsets = toxicity.word_features(np.frombuffer(data, np.uint8), np.array([0, 11, 11, len(data)]))
    assert np.diff(offsets).tolist() == [2, 0, 2]
    assert sorted(np.round(value, 3).tolist()) == sorted(np.round(np.log1p([1, 2, 1, 1]), 3).tolist())
