from pyspark.sql import functions as F

from tessera.llm import decontaminate as D
from tessera.llm.decontaminate import contamination, decontaminated

ITEM = "In the shop Alice had 12 kg of red apples and sold 5 of them to Bob, so how many are left with Alice now after that?"


def bench(spark, rows=((1, ITEM), (2, None), (3, "too short"), (4, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_copies_and_new_values(spark, documents, rows):
    docs = documents(
        [
            (1, f"words in front. {ITEM} and words behind."),
            (2, "Text. In the shop Maria had 77 kg of red apples and sold 9 of them to Tom, so how many are left with Maria now after that? End."),
            (3, "Text. In the shop Maria had 77 kg of red apples and sold 9 of them to Tom, so how many are left with Zoe now after those days? End."),
            (4, "the shop had red apples and many are left"),
            (5, None),
            (6, ""),
            (7, ITEM.upper()),
            (None, ITEM),
        ]
    )
    got = {(r.doc_id, r.item_id): r.kind for r in contamination(docs, bench(spark)).collect()}
    assert got[1, 1] == "copy" and got[2, 1] == "reparameterised" and (4, 1) not in got and (5, 1) not in got
    assert got[7, 1] == "copy" and {k[0] for k in got} <= {1, 2, 3, 7}
    kept = {r.doc_id for r in decontaminated(docs, bench(spark)).collect()}
    assert {4, 5, 6, None} <= kept and not kept & {1, 2}
    assert decontaminated(docs, bench(spark)).columns == docs.columns


def test_inconsistent_slots(spark, documents):
    item = "Then Ana met Bea and Ana told Bea that Ana would pay Bea what Ana owed Bea before Ana left Bea at home."
    good, bad = item.replace("Ana", "Kim").replace("Bea", "Lou"), item
    for k, name in enumerate(["Kim", "Lou", "Max", "Ned", "Pia", "Quy", "Ray", "Sue", "Tom", "Una"]):
        bad = bad.replace("Ana" if k % 2 == 0 else "Bea", name, 1)
    got = contamination(documents([(1, f"so it was. {good}"), (2, f"so it was. {bad}")]), bench(spark, [(9, item)]))
    assert [(r.doc_id, r.consistency) for r in got.collect()] == [(1, 1.0)]


def copies(spark, documents, items, docs):
    """item found by document, and its kind."""
    found = contamination(documents(list(enumerate(docs))), bench(spark, list(enumerate(items)))).collect()
    return {(r.doc_id, r.item_id): r.kind for r in found}


def test_capitals_and_what_precedes(spark, documents):
    france, train = "What is the capital city of France?", "Alice has 12 apples. Alice gives 5 to Bob. How many apples does Alice have left?"
    docs = [france.lower(), f"Q: {france} A: Paris", f"Question: {france}", france.upper(), "Q: What is the capital city of Peru? A: Lima", train.replace("Alice", "Maria Lopez"), f"so, {train.lower()}", "what is the point of it all"]
    got = copies(spark, documents, [france, train], docs)
    assert got == {(0, 0): "copy", (1, 0): "copy", (2, 0): "copy", (3, 0): "copy", (4, 0): "reparameterised", (5, 1): "reparameterised", (6, 1): "copy"}


def test_short_items_and_numbers(spark, documents):
    items = ["Compute 12 + 7 - 3", "Solve for x quickly", "What is 17 times 23?", "12 + 7 - 3 * 4 + 25 - 6 =", "yes", "Paris, France"]
    docs = ["Now: compute 12 + 7 - 3 and say", "please SOLVE for X quickly.", "Q: What is 17 times 23? A: 391", "see 12 + 7 - 3 * 4 + 25 - 6 = 2", "Yes!", "paris france"]
    clean = ["compute 12 + 7 - 4", "solve for y quickly", "12 + 7 - 3 * 5 + 25 - 8 = 1", "yes it is", "the town of Paris, France", "1 2 3 4 5 6 7 8"]
    got = copies(spark, documents, items, docs + clean)
    assert {k for k in got} == {(k, k) for k in range(6)} and set(got.values()) == {"copy"}
    assert copies(spark, documents, items, ["What is 18 times 29?"]) == {(0, 2): "reparameterised"}


def test_a_broken_variant_in_front(spark, documents):
    item = "A train leaves Rome at 9 and drives 120 km in 3 hours, then 80 km in 2 hours more. How far is that from Rome?"
    broken = item.replace("120", "7").replace("3 hours", "5 hours")[:70]
    whole = item.replace("Rome", "Oslo").replace("120", "240").replace("80", "33")
    assert copies(spark, documents, [item], [f"{broken}. And so on it went. {whole}", f"{broken} {broken}"]) == {(0, 0): "reparameterised"}


def test_all_new_values_against_brute_force(spark, documents, prose):
    """Items with numbers, names and units asked anew: found in every document that holds one, in no other."""
    import random

    rng = random.Random(2)
    names = ["Ada", "Ben", "Cora", "Dan", "Eva", "Finn"]

    def ask(words, who, a, b):
        return f"{who} {words[:40]} {a} kg of {words[40:80]} and {b} of {words[80:120]} so {who} {words[120:160]}?"

    shapes = [prose(40) for _ in range(8)]
    items = [ask(w, "Zoe", 12, 99) for w in shapes]
    docs, want = [], set()
    for k in range(64):
        if k % 2:
            docs.append(f"{prose(30)} {ask(shapes[k % 8], rng.choice(names), rng.randint(100, 900), rng.randint(100, 900))} {prose(30)}")
            want.add((k, k % 8))
        else:
            docs.append(f"{prose(30)} {ask(prose(40), 'Zoe', 12, 99)} {prose(30)}")
    got = copies(spark, documents, items, docs)
    assert set(got) == want and set(got.values()) == {"reparameterised"}


def test_ties_repeats_and_long_texts(spark, documents, prose):
    other = "Some quite other item about nothing of the kind, with 17 words or so in it, they say."
    docs = [(1, ITEM), (1, ITEM), (1, "another text"), (2, f"{prose(60_000)} {other} {ITEM.lower()}"), (3, None)]
    got = sorted((r.doc_id, r.item_id, r.kind, r.coverage) for r in contamination(documents(docs), bench(spark, [(1, ITEM), (1, other), (1, ITEM), (2, other), (None, ITEM)])).collect())
    assert got == [(1, 1, "copy", 1.0), (2, 1, "copy", 1.0), (2, 2, "copy", 1.0)]
    assert [r.doc_id for r in decontaminated(documents(docs), bench(spark)).collect()] == [3]


def test_like_exercise_in_front_of_a_copy(spark, documents):
    item = "Then a train travels 120 km in 3 hours so who of them is faster here?"
    front = "For one a train travels 60 km in 7 hours as they say."
    docs = documents([(1, f"{front} {item}"), (2, f"{item} {front}"), (3, front), (4, f"{front} {item.replace('120', '46')}")])
    got = sorted((r.doc_id, r.coverage, r.consistency, r.kind) for r in contamination(docs, bench(spark, [(9, item)])).collect())
    assert got == [(1, 1.0, 1.0, "copy"), (2, 1.0, 1.0, "copy"), (4, 1.0, 1.0, "reparameterised")]
    assert [r.doc_id for r in decontaminated(docs, bench(spark, [(9, item)])).collect()] == [3]


def test_all_items_against_brute_force(spark, documents, prose):
    items = [(k, prose(25)) for k in range(12)]
    docs = [(k, f"{prose(40)} {items[k % 12][1]} {prose(30)}" if k % 3 == 0 else prose(80)) for k in range(60)]
    want = {(i, j) for i, t in docs for j, x in items if x in t}
    assert {(r.doc_id, r.item_id) for r in contamination(documents(docs), bench(spark, items)).collect()} == want


def test_least_coverage_by_telling_windows(spark, documents, prose, monkeypatch):
    """Wherever a copy is broken, it is found while 0.8 of the item's windows are left; the first reading hashes few windows."""
    items = [(k, prose(n)) for k, n in enumerate((24, 29, 5, 9, 14))]
    docs, want = [], set()
    for i, text in items:
        w = text.split()
        for a in range(len(w)):
            for b in range(a, min(a + 6, len(w))):
                left = sum(not any(a <= j + o < b for o in range(5)) for j in range(len(w) - 4))
                if left >= 0.8 * (len(w) - 4):
                    want.add((len(docs), i))
                docs.append(f"{prose(9)} {' '.join([*w[:a], *['zzz'] * (b - a), *w[b:]])} {prose(9)}")
    docs = documents(list(enumerate(docs)))
    for most in (D.ANCHORS, 2):
        monkeypatch.setattr(D, "ANCHORS", most)
        assert {(r.doc_id, r.item_id) for r in contamination(docs, bench(spark, items)).collect()} == want
    told = D.telling(D.item_marks(bench(spark, items)))
    assert {(r.item_id, r["count"]) for r in told.groupBy("item_id").count().collect()} == {(0, 5), (1, 6), (2, 1), (3, 2), (4, 3)}
    firsts = {"plain": [r.word for r in told.select("word").distinct().collect()]}
    few, every = (D.document_marks(docs, ["doc_id"], {"plain": [5]}, lambda at, h: h, f) for f in (firsts, None))
    assert few.count() < every.count() / 2 and few.exceptAll(every).isEmpty()
    hashes = told.select("hash")
    assert few.join(hashes, F.col("w") == hashes["hash"]).count() == every.join(hashes, F.col("w") == hashes["hash"]).count() > 0


def test_empty(spark, documents):
    assert contamination(documents([]), bench(spark)).count() == 0
    assert contamination(documents([(1, ITEM)]), bench(spark, [])).count() == 0
