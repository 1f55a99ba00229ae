import numpy as np
from pyspark.sql import functions as F

from antecede.llm import language
from antecede.llm.store import table


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1 AND lang IS NOT NULL")
    got = {r.id: (r.lang_pred, r.score) for r in language.predict(rest, model).collect()}
    want = {r.doc_id: r.lang for r in rest.collect()}
    assert np.mean([got[i][0] == lang for i, lang in want.items()]) >= 0.97
    assert all(0 <= s <= 1 for _, s in got.values())


def test_texts_without_letters(spark, frame, cases):
    model = language.fit(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "fr"), (4, "x", None)],
                                               "doc_id int, text string, lang string"))
    assert model.languages == ["de", "en"]
    rows = [*cases, (20, "123 !?"), (21, "1 the dog"), (22, "漢字")]
    got = [(r.id, r.lang_pred, r.score) for r in language.predict(frame(rows), model).collect()]
    assert len(got) == len(rows)
    unknown = {i for i, lang, s in got if lang == language.UNKNOWN and s == 0}
    assert unknown == {1, 2, 3, 7, 20}
    assert {lang for i, lang, _ in got if i == 21} == {"en"}


def test_no_labelled_text_and_empty_table(frame):
    model = language.fit(frame([(1, "abc")]).withColumn("lang", F.lit(None).cast("string")))
    assert [r.lang_pred for r in language.predict(frame([(1, "abc")]), model).collect()] == [language.UNKNOWN]
    assert language.predict(frame([]), model).count() == 0


def test_grams_stay_inside_their_text():
    both, offsets = language.gram_buckets(["ab", "", "c!d"])
    alone = [language.gram_buckets([t])[0] for t in ["ab", "", "c!d"]]
    assert [sorted(both[a:b]) for a, b in zip(offsets, offsets[1:])] == [sorted(x) for x in alone]


def test_symbols_beyond_the_basic_plane_are_no_letters(spark, frame):
    model = language.fit(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")], "doc_id int, text string, lang string"))
    got = {r.id: (r.lang_pred, r.score) for r in language.predict(frame([(1, "😀🎉 🚀"), (2, "𠀀𐐷")]), model).collect()}
    assert got[1] == (language.UNKNOWN, 0.0) and got[2][0] in ("de", "en")
    mixed, plain = (language.gram_buckets([t])[0].tolist() for t in ("the 😀 dog", "the ! dog"))
    assert mixed == plain
