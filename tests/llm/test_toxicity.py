"""Levenshtein automata against plain distances, windows, and what a toxicity model learns from planted documents."""

import random

import pytest

from strandline.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_near(word, terms):
    out = {}
    for k, (term, stem) in enumerate(terms):
        d = min(distance(word[:n], term) for n in range(len(word) + 1)) if stem else distance(word, term)
        if d <= toxicity.errors(term, stem):
            out[k] = d
    return out


TERMS = [("scum", False), ("idiot", False), ("pathetic", False), ("disgusting", False), ("lowei", True), ("lostra", True), ("verräterisch", True), ("ничтожество", False), ("idiotic", False)]


def test_automata_give_plain_distances_and_masks_lose_nothing():
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzüßéщ"
    many = {t for t, _ in TERMS} | {"", "a", "oron", "İx", "𐐀idiot"}
    for _ in range(3000):
        word = list(rng.choice(TERMS)[0]) + list(rng.choice(["", "", "x", "tum", "weise"]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        many.add("".join(word))
    matcher = toxicity.Matcher(TERMS)
    found = matcher(many)
    for word in many:
        assert (found.get(word, {}) if word else {}) == (plain_near(word, TERMS) if word else {})
    assert toxicity.Matcher(TERMS, frozenset({"idiom"}))({"idiom", "idiots"}).keys() == {"idiots"}
    assert toxicity.Matcher([])({"idiot"}) == {} and matcher(set()) == {}


def test_windows_and_quotation():
    text = 'One two three "four five idiot six" seven idiot.\nHe said “idiot” and «scum eight» "idiot\nidiot'
    found = list(toxicity.hits(text, {"idiot", "scum"}))
    assert [(h.word, h.quoted) for h in found] == [("idiot", True), ("idiot", False), ("idiot", True), ("scum", True), ("idiot", True), ("idiot", False)]
    assert found[0].around == ["one", "two", "three", "four", "five", "six", "seven", "idiot", "he", "said"]
    assert found[-1].around == ["idiot", "and", "scum", "eight", "idiot"]


def test_direct_words(monkeypatch):
    text = 'one "two three" four. he said five six seven eight nine ten\n"eleven\ntwelve'
    assert toxicity.direct_words(text) == {"ten", "twelve"}
    assert toxicity.direct_words("x " * 8 + "schrieb " + "y " * 6) == {"x", "y"}
    long = " ".join(f"w{k} " + ("said" if k % 50 == 0 else "") for k in range(1000))
    whole = toxicity.direct_words(long)
    monkeypatch.setattr(toxicity, "PART", 17)
    assert toxicity.direct_words(long) == whole


@pytest.fixture(scope="module")
def planted(spark):
    """Documents with invented insults: abuse is toxic; quoted and reported insults, mostly, are not."""
    rng = random.Random(2)
    plain = ["".join(rng.choice(["ka", "mo", "ri", "ten", "su", "pol", "ven"]) for _ in range(rng.randrange(2, 5))) for _ in range(400)]
    insults = ["zorgblat", "quixnark"]

    def text(kind):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(words))
            insult = rng.choice(insults + ["grumpf" + rng.choice(plain)])
            if kind == "abuse":
                words[at:at] = ["you", insult]
            elif kind == "clean":
                words[at:at] = ["you"]
            elif kind == "quote":
                words[at:at] = ["he", "said", f'"{insult}"']
        return " ".join(words) + "."

    rows = [(k, *((text("abuse"), 1) if k % 4 == 0 else (text("quote"), 0) if k % 4 == 1 else (text("clean"), 0))) for k in range(1200)]
    rows += [(2000 + k, rows[1][1] + f" {plain[k % 50]}", 0) for k in range(100)]  # near copies of a clean one
    rows += [(3000 + k, f"{plain[k % 50]} {rows[0][1]} a raretoken", 1) for k in range(60)]  # and of a toxic one
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows if i % 5] + [(4, 0, None), (8, 0, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, toxicity.fit(toxicity.sample(docs, labels)), insults, plain


def test_quotation_is_told_from_abuse(spark, planted):
    rows, docs, model, insults, _ = planted
    assert {t for t, stem in model.terms if not stem} == set(insults) and ("grumpf", True) in model.terms
    assert len(model.terms) == 3
    label = {i: y for i, _, y in rows}
    held = [r for r in toxicity.score(docs, model).collect() if r.doc_id % 5 == 0]
    assert len(held) > 200 and sum(label[r.doc_id] == r.predicted for r in held) >= 0.98 * len(held)


def test_misspelled_terms_are_caught(spark, planted):
    _, _, model, _, plain = planted
    calm = " ".join(plain[:30])
    odd = [
        (0, f"{calm} you zorgbalt {calm}", 0),  # two letters change places: two errors, one too many for eight letters
        (1, f"{calm} you zorgblatt {calm}", 1),
        (2, f"{calm} you QUIXNRK {calm}", 1),
        (3, f"{calm} you gromkateri {calm}", 0),
        (4, f'{calm} he said "zorgblatt" {calm}', 0),
        (5, calm, 0),
    ]
    found = {r.doc_id: r for r in toxicity.score(spark.createDataFrame([r[:2] for r in odd], "doc_id long, text string"), model).collect()}
    assert {i: found[i].predicted for i, *_ in odd} == {i: y for i, _, y in odd}


def test_odd_documents(spark, odd_docs, no_docs, planted):
    model = planted[2]
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 5)}) == 1
    assert toxicity.score(no_docs, model).collect() == []
    long = "katen " * 300_000 + "you zorgblat you quixnark " + "rimo " * 300_000
    assert [r.predicted for r in toxicity.score(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).collect()] == [1]


def test_without_labels_of_both_classes(spark, odd_docs):
    def constant(rows):
        return toxicity.fit(toxicity.sample(odd_docs, spark.createDataFrame(rows, "doc_id long, toxic int"))).constant

    assert constant([]) == 0.0 and constant([(1, 1), (None, 0)]) == 1.0 and constant([(1, 0), (3, 0)]) == 0.0 and constant([(3, 1), (4, 0)]) == 0.5
    assert constant([(1, 1), (1, 0), (7, 1), (3, None)]) == 0.0
    model = toxicity.fit(toxicity.sample(odd_docs, spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, toxic int")))
    assert {(r.score, r.predicted) for r in toxicity.score(odd_docs, model).collect()} == {(0.5, 1)}
