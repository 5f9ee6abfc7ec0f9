"""Decontamination: benchmark items that are copied or re-parameterised in part."""

import random

import pyarrow as pa
import pytest

from navspark.llm.decontaminate import contaminated, match_item, templates

FILLER = "quick brown stories about distant harbours and lazy rivers under some pale moon "


def match(item, text):
    """[(words covered, first word, slots changed)] by trying every diagonal."""
    t, i = (templates(pa.array([x])) for x in (text, item))
    found = match_item(t, i, range(-len(i.number), len(t.number)))
    return [found[1:]] if found else []


def test_one_edited_value_loses_no_long_copy():
    random.seed(1)
    words = ["1999" if k % 20 == 10 else f"word{random.randint(0, 999)}" for k in range(200)]
    edited = [*words[:10], "2001", *words[11:]]
    assert match(" ".join(words), FILLER + " ".join(edited)) == [(189, 13 + 11, 0)]
    words[12] = edited[12] = "1999"
    assert match(" ".join(words[:22]), FILLER + " ".join(edited[:22])) == []  # no consistent part of 13 words


def test_two_values_made_equal():
    item = "add 3 to the first heap of stones and then carry 5 over the long bridge before the old miller closes his gate"
    assert match(item, item.replace("3", "4").replace("5", "4")) == [(21, 2, 1)]


def test_short_item_after_a_heading():
    item = "What is the capital of the old kingdom near Spain?"
    assert match(item, FILLER + "Quiz\n" + item) == [(10, 14, 0)]


def test_renamed_name_that_begins_sentences():
    item = "Tom has 5 apples. Tom buys 3 more. Tom eats 2. How many apples does Tom have left now?"
    assert match(item, FILLER + item.replace("Tom", "Ann")) == [(18 + 1, 13, 1)]


def test_runs_of_one_diagonal_are_added_up():
    words = [f"w{k}x" for k in range(19)]
    assert match(" ".join(words), " ".join([*words[:9], "other", *words[10:]])) == [(18, 0, 0)]
    assert match(" ".join(words), " ".join([*words[:9], "one", "other", *words[10:]])) == []


@pytest.mark.parametrize(
    ("item", "old", "new"),
    [
        ("Der Bauer verkauft zwölf Körbe mit Äpfeln auf dem Markt und kauft danach eine Kuh für den Hof seiner Schwester", "zwölf", "zwanzig"),
        ("Der Bauer verkauft zwölf Körbe mit Äpfeln auf dem Markt und kauft danach eine Kuh für den Hof seiner Schwester", "zwölf", "zweiunddreißig"),
        ("Le fermier vend douze paniers de pommes au marché et achète ensuite une vache pour la ferme de sa sœur", "douze", "quatre-vingt-dix"),
        ("El granjero vende doce cestas de manzanas en el mercado y luego compra una vaca para la granja de su hermana", "doce", "veintiuno"),
        ("The farmer sells twelve baskets of apples at the market and then buys a cow for the farm of his sister", "twelve", "twenty-one"),
        ("Der Zug braucht drei Stunden von der alten Brücke bis zum Bahnhof der Stadt und hält dort am Abend lange", "Stunden", "Tage"),
    ],
)
def test_numbers_and_units_in_four_languages(item, old, new):
    (found,) = match(item, FILLER + item.replace(old, new))
    assert found == (len(item.split()), 13, 1)


def test_many_items_that_share_a_window(spark):
    shared = "which of the following is true about the"
    items = [(k, f"{shared} " + " ".join(f"w{k}x{j}" for j in range(9))) for k in range(5000)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = [(0, f"{FILLER}{shared} weather in spring"), (1, FILLER + items[4321][1] + " indeed"), (2, FILLER), (3, None)]
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert [(r.doc_id, r.item_id, r.changed_slots) for r in found.collect()] == [(1, 4321, 0)]


def test_copies_of_numbers():
    item = "What number comes next in 1, 2, 4, 8, 16, 32, 64, 128?"
    assert match(item, FILLER + item) == [(13, 13, 0)]
    assert match(item, item.replace("16", "17").replace("32", "40")) == []  # too few words that are not slots


def test_items_shorter_than_a_window():
    assert match("Who wrote Hamlet?", FILLER + "who wrote Hamlet? " + FILLER) == [(3, 13, 0)]
    assert match("Who wrote Hamlet?", "who wrote Faust? " + FILLER) == []
    assert match("Who wrote Hamlet?", "") == []
