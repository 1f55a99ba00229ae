import pytest

from antecede.llm.templates import leaks

ITEM = "If Alice buys 12 apples and Bob buys 5 kg of pears, how many fruits does Alice carry home after Bob leaves the old market?"
OTHER = "Name the capital of the country whose longest river was first mapped by an expedition of three hundred men."


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (2, OTHER, "y"), (3, None, "z"), (4, "too short", "z"), (5, "", "z")], "item_id int, text string, hash string")


def found(frame, bench, rows):
    return {(r.id, r.item): (round(r.similarity, 2), r.changed) for r in leaks(frame(rows), bench).collect()}


def test_copies_and_re_parameterised_questions_are_caught(frame, bench):
    other = ITEM.replace("Alice", "Zoe").replace("Bob", "Max").replace("12", "1,250.5").replace("5 kg", "9 lb")
    noise = "unrelated words come before it and "
    got = found(frame, bench, [(1, noise + ITEM + " and after."), (2, noise + other), (3, noise + ITEM.upper()), (4, ITEM.replace("old", "very old")),
                               (5, f"{ITEM} {OTHER}"), (6, noise * 3), (7, None), (8, ""), (9, "If Alice")])
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (5, 2)}
    assert got[1, 1] == (1.0, 0) and got[2, 1] == (1.0, 5) and got[4, 1][0] >= 0.8


def test_inconsistent_slots_and_parts_do_not_leak(frame, bench):
    twisted = ITEM.replace("Alice buys", "Zoe buys").replace("Alice carry", "Tom carry")
    half = ITEM[:60] + " then something else entirely follows and goes on for a good while"
    assert not found(frame, bench, [(1, twisted), (2, half)])


def test_repeated_rows_and_empty_tables(frame, bench):
    assert set(found(frame, bench, [(1, ITEM), (1, ITEM), (None, ITEM)])) == {(1, 1), (None, 1)}
    assert not found(frame, bench, [])
    assert leaks(frame([(1, ITEM)]), bench.where("false")).count() == 0


def test_latin_capitals_match_their_small_letters(frame, spark):
    text = "Où étaient éparpillés les élèves émus quand l'été s'achevait près des îles"
    bench = spark.createDataFrame([(1, text)], "item_id int, text string")
    assert found(frame, bench, [(1, text.upper())]) == {(1, 1): (1.0, 0)}


def test_equal_windows_count_beside_inconsistent_slots(frame, spark):
    words = [f"plain{k}" for k in range(59)]
    words[3] = words[40] = "Anna"
    changed = [*words[:3], "Mary", *words[4:]]
    more = [w if k % 12 else "Anna" for k, w in enumerate(changed)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id int, text string")
    got = found(frame, bench, [(1, " ".join(changed)), (2, " ".join(more))])
    assert got == {(1, 1): (round(51 / 55, 2), 1)}
