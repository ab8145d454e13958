import random
import re
from collections import defaultdict

from quillcast.llm.decontaminate import drop_contaminated, find_contamination
from quillcast.llm.queries import op10_benchmark_decontamination

ITEM = "A shop sells 12 red apples and 30 green pears each day, and Alice buys 12 of the apples for 5 dollars in all."


def found(spark, docs, items=((1, ITEM),), **options):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.coverage for r in find_contamination(d, b, **options).collect()}


def test_new_numbers_names_and_units_are_caught_if_they_agree(spark):
    filler = "Some other words come before this. " * 20
    docs = [
        (1, f"{filler}{ITEM} {filler}", 0),
        (2, f"{filler}{ITEM.replace('12', '7').replace('30', '8').replace('Alice', 'Zoltan').replace('dollars', 'euros')} {filler}", 0),
        (3, f"{filler}{ITEM.replace('12', '7', 1)} {filler}", 0),
        (4, filler, 0),
        (5, ITEM.upper(), 0),
        (6, f"{ITEM.replace('12', '7')} {filler} {ITEM.replace('12', '9')}", 0),
        (7, " ".join(ITEM.split()[:8]), 0),
    ]
    assert set(found(spark, docs)) == {(1, 1), (2, 1), (5, 1), (6, 1)}


SELLERS = "Ann sells for 3 dollars, Bob sells for 5 dollars, Cid sells for 7 dollars, and how much is that?"


def test_repeats_within_an_item_do_not_tear_its_copies(spark):
    filler = "Some other words come before this. " * 20
    renamed = SELLERS.replace("Ann", "Zoe").replace("3", "4").replace("5", "6").replace("7", "9")
    docs = [
        (1, SELLERS, 0),
        (2, f"{filler}{SELLERS} {filler}", 0),
        (3, f"{filler}{renamed} {filler}", 0),
        (4, SELLERS.replace("Bob sells", "Bob also sells"), 0),
        (5, SELLERS.replace("Ann sells", "Ann vends"), 0),
        (6, f"{filler}{SELLERS.replace('dollars', 'euros', 1)}", 0),
        (7, filler, 0),
    ]
    got = found(spark, docs, [(1, SELLERS)])
    assert set(got) == {(d, 1) for d in (1, 2, 3, 4, 5)}
    assert got[1, 1] == got[2, 1] == 1 and got[3, 1] > 0.9  # a sentence's first word is no name


def test_names_and_numbers_of_several_words_fill_one_slot(spark):
    filler = "Some other words come before this. " * 20
    docs = [
        (1, f"{filler}{ITEM.replace('Alice', 'Maria Garcia')} {filler}", 0),
        (2, f"{filler}{ITEM.replace('12', '7 hundred')} {filler}", 0),
        (3, f"{filler}{ITEM.replace('12', 'twenty-five').replace('Alice', 'Jan de Vries').replace('Jan de', 'Jan')} {filler}", 0),
        (4, f"{filler}{ITEM.replace('12', '7 hundred', 1)} {filler}", 0),
        (5, filler, 0),
    ]
    assert set(found(spark, docs)) == {(1, 1), (2, 1), (3, 1)}
    items = [(1, ITEM.replace("Alice", "Maria Garcia").replace("12", "two hundred"))]
    assert set(found(spark, [(1, ITEM, 0), (2, filler, 0)], items)) == {(1, 1)}


def test_templates_against_brute_force(spark):
    """Questions made from templates: a document holds a question's template if its values fill the slots alike."""
    rng = random.Random(6)
    names, nouns, things = ["Alice", "Bob", "Maria Garcia", "Chen"], ["apples", "pears", "coins", "stamps"], ["box", "bag", "shop"]
    templates = [
        lambda a, b, n, m: f"Every day the shop sends {n} {nouns[0]} to {a} while {b} asks for {m} more and returns {n} of them to the shop in the evening.",
        lambda a, b, n, m: f"How many {nouns[1]} are left over if {a} had {n} of them and {b} took away {m} but {a} found {m} under the table again?",
        lambda a, b, n, m: f"There are {n} {nouns[2]} in the {things[1]} of {a} and exactly {m} in the one that {b} carried home from the market that day.",
    ]
    fill = lambda: (*rng.sample(names, 2), *rng.sample(range(2, 900), 2))
    items = [(i, templates[i % 3](*fill())) for i in range(30)]
    docs, expected = [], set()
    for d in range(60):
        kind = rng.choice(["clean", "same", "torn"])
        t = rng.randrange(3)
        text = templates[t](*fill()) if kind == "same" else ""
        if kind == "torn":  # each mention has a value of its own
            text = re.sub(r"\d+", lambda m: str(rng.randint(1000, 9999)), templates[t](*fill()))
            text = re.sub("|".join(names), lambda m: rng.choice(["Otto", "Ida", "Nils", "Eva"]) + rng.choice(["bert", "na", "son"]), text)
        docs.append((d, "Plain words go before it here. " * 3 + text + " And others come after that.", 0))
        if kind == "same":
            expected |= {(d, i) for i, _ in items if i % 3 == t}
        elif kind == "torn" and t == 2:  # no value of this one comes twice: any values fill it
            expected |= {(d, i) for i, _ in items if i % 3 == t}
    assert set(found(spark, docs, items)) == expected and expected


def test_documents_against_brute_force(spark, sf_dir):
    norm = lambda t: [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x).lower() for x in (t or "").split()) if w]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    index, size = defaultdict(set), {}
    for r in items:
        w = norm(r.text)
        size[r.item_id] = len(w) - 4
        for i in range(len(w) - 4):
            index[tuple(w[i : i + 5])].add((r.item_id, i))
    expected = set()
    for r in docs:
        w, hit = norm(r.text), defaultdict(set)
        for i in range(len(w) - 4):
            for item, at in index.get(tuple(w[i : i + 5]), ()):
                hit[item].add(at)
        expected |= {(r.doc_id, item) for item, at in hit.items() if len(at) >= 0.6 * size[item]}
    assert {(r.doc_id, r.item_id) for r in op10_benchmark_decontamination(spark, sf_dir).collect()} == expected
    assert expected


def test_odd_rows(spark):
    docs = [(None, ITEM, 1), (2, None, 1), (3, "", 1), (4, ITEM, 1), (4, ITEM, 1), (5, "x " * 100_000 + ITEM, 1)]
    items = [(1, ITEM), (1, ITEM), (None, ITEM), (2, None), (3, ""), (4, "only four words here"), (5, "1 2 3 4 5 6 7 8")]
    got = found(spark, docs, items)
    assert set(got) == {(d, i) for d in (None, 4, 5) for i in (1, None)}
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r.doc_id for r in drop_contaminated(d, b).collect()) == [2, 3]
    assert find_contamination(d.limit(0), b).collect() == [] and find_contamination(d, b.limit(0)).collect() == []
