import random

import numpy as np
import pytest

from tidemark.llm.leakage import Index, answered, leaked_items, leaks_of, plain, stream

WORDS = [a + b + c for a in ("ba", "lo", "mi", "tru", "ve", "ska") for b in ("n", "r", "lt", "st") for c in ("a", "eg", "im", "o", "und")]


def text(seed, n=70):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(["", "", ","])) for _ in range(n)).capitalize() + "."


ITEMS = [(i, text(i), f"answer{i}") for i in range(30)]
OPTIONS = dict(passage=200, threshold=100.0, least_words=25)


def found(doc):
    return {x[0] for x in leaks_of(doc, Index.build(ITEMS), **OPTIONS)}


def words(i):
    return ITEMS[i][1].split()


@pytest.mark.parametrize(
    "change",
    [
        lambda w: " ".join(w),
        lambda w: " ".join(w).upper(),
        lambda w: "<p>" + "</b> <b>".join(w) + "&nbsp;</p>",
        lambda w: "".join(w),
        lambda w: "​".join(" ".join(w)),
        lambda w: " ".join(w).translate({ord(c): 0xFEE0 + ord(c) for c in "abegimn"}),
        lambda w: " ".join(w).replace("a", "а"),
        lambda w: "\n> ".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5)),
        lambda w: " ".join(x for i, x in enumerate(w) if i % 10 != 4),
        lambda w: " ".join("quatsch" if i % 10 == 4 else x for i, x in enumerate(w)),
        lambda w: " ".join(x + " indeed" if i % 10 == 4 else x for i, x in enumerate(w)),
    ],
)
def test_forms_of_whole_items_and_passages(change):
    noise = text(999, 200)
    assert found(f"{noise} {change(words(3))} {noise}") == {3}
    assert found(f"{noise} {change(words(5)[20:52])} {noise}") == {5}


def test_short_quotations_and_other_texts_are_no_case():
    noise = text(999, 200)
    assert found(f"{noise} {' '.join(words(3)[:18])} {noise}") == set()
    assert found(noise) == found("") == found(None) == set()


@pytest.mark.parametrize("edited", [(1, 23), (2, 22), (3, 21), (0, 2, 22), (1, 12, 22)])
def test_passages_of_the_least_length_with_edited_words_near_their_edges(edited):
    noise = text(999, 200)
    for i in (3, 5, 8, 11):
        for new in (lambda x: "quatsch", lambda x: "", lambda x: x + " quatsch"):
            told = [new(x) if n in edited else x for n, x in enumerate(words(i)[20:45])]
            assert found(f"{noise} {' '.join(told)} {noise}") == {i}
        told = ["quatsch" if n in edited else x for n, x in enumerate(words(i)[20:38])]
        assert found(f"{noise} {' '.join(told)} {noise}") == set()


@pytest.mark.parametrize("between", [10, 400])
def test_a_passage_beside_a_longer_stretch_of_shared_sentences(between):
    r, frame = random.Random(7), text(500, 60).split()
    rare = lambda: "".join(r.choice("bcdfglmnprstvz") + r.choice("aeiou") for _ in range(4))
    filled = lambda: " ".join(rare() if n % 6 == 5 else w for n, w in enumerate(frame))
    items = [(i, f"{filled()} {' '.join(rare() for _ in range(30))}", "") for i in range(30)]
    own = " ".join(items[4][1].split()[62:88])
    doc = f"{text(999, 100)} {own} {text(998, between)} {filled()} {text(997, 100)}"
    assert {x[0] for x in leaks_of(doc, Index.build(items), **OPTIONS)} == {4}


@pytest.mark.parametrize("items", [ITEMS[3:4], ITEMS[3:5], [(i, ITEMS[3][1], "") for i in range(100)] + ITEMS[4:9]])
def test_small_and_skewed_indexes_find_passages(items):
    noise, wanted = text(999, 200), {i for i, t, _ in items if t == ITEMS[3][1]}
    for doc in (" ".join(words(3)[20:45]), " ".join("quatsch" if n in (8, 17) else w for n, w in enumerate(words(3)[20:45]))):
        got = [x[0] for x in leaks_of(f"{noise} {doc} {noise}", Index.build(items), **OPTIONS)]
        assert set(got) == wanted and len(got) == len(wanted)
    assert leaks_of(noise, Index.build(items), **OPTIONS) == []


def test_blocks_find_what_one_index_finds(spark):
    noise = text(999, 60)
    docs = spark.createDataFrame([(i, f"{noise} {' '.join(words(i)[10:36])} {noise}") for i in range(8)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:8], "item_id long, text string, answer string")
    for block in (2_000_000, 600):
        got = leaked_items(docs, items, block_chars=block, doc_id="doc_id", text="text", item_id="item_id", item_text="text", item_answer="answer")
        assert sorted((r.doc, r.item) for r in got.collect()) == [(i, i) for i in range(8)]


def test_wand_finds_what_full_scoring_finds():
    index = Index.build(ITEMS)
    r = random.Random(4)
    for _ in range(50):
        query = r.sample(range(len(index.terms)), 60)
        of = {t: dict(zip(index.docs[a:b].tolist(), index.impact[a:b].tolist(), strict=True)) for t in query for a, b in [(index.first[t], index.first[t + 1])]}
        full = [sum(of[t].get(n, 0.0) for t in query) for n in range(len(ITEMS))]
        for threshold in (1.0, 4.0, 12.0):
            sure = {n for n, s in enumerate(full) if s > threshold + 1e-9}
            got = set(index.above(np.array(query), threshold))
            assert sure <= got <= {n for n, s in enumerate(full) if s > threshold - 1e-9}


def test_plain():
    assert plain("<b>É&amp;Ü</b> ﬁ ß") == " e&u  fi ss"
    assert plain("pÃºblico") == "publico"
    assert len(stream("a-b c1")) == 4


def test_frames(spark):
    noise = text(999, 60)
    docs = spark.createDataFrame([(1, " ".join(words(2)), "c"), (1, " ".join(words(2)), "c"), (2, noise, "c"), (3, None, "c"), (4, "", "c"), (5, (noise + " ") * 300 + " ".join(words(7)), "c")], "doc_id long, text string, item string")
    items = spark.createDataFrame([*ITEMS, ITEMS[2], (77, None, None), (78, "", ""), (79, "abc", None)], "item_id long, text string, answer string")
    args = dict(doc_id="doc_id", text="text", item_id="item_id", item_text="text", item_answer="answer")
    for block in (8_000_000, 4_000):
        got = leaked_items(docs, items, block_chars=block, threshold=60.0, **args)
        assert sorted((r.doc, r.item) for r in got.collect()) == [(1, 2), (1, 2), (5, 7)]
    assert leaked_items(docs.where("1 = 0"), items, **args).count() == 0
    assert leaked_items(docs, items.where("1 = 0"), **args).count() == 0


def test_answers_are_whole_words():
    assert answered("2-1", "It ended 2-1.") and not answered("2-1", "It ended 12-14.")
    assert answered("Calan Mor", "by <b>CALAN</b> Mor") and answered("Calan Morwel", "Calan-M o r w e l") and not answered("", "any") and not answered("al", "Calan")


def test_recall_and_precision_over_planted_passages():
    """Passages of 25 to 60 words with a tenth of them edited, in documents of other words; shorter quotations beside."""
    r, index = random.Random(11), Index.build(ITEMS)
    wanted = got = right = 0
    for n in range(150):
        i = r.randrange(len(ITEMS))
        w = words(i)
        length = min(len(w), r.choice([26, 30, 40, 60]))
        a = r.randrange(len(w) - length + 1)
        told = [x for x in w[a : a + length] for x in ([x] if r.random() > 0.1 else r.choice([["quatsch"], [], [x, "indeed"]]))]
        j = (i + 7) % len(ITEMS)
        short = words(j)[30:45]
        doc = f"{text(2000 + n, 150)} {' '.join(told)} {text(3000 + n, 60)} {' '.join(short)} {text(4000 + n, 90)}"
        found = {x[0] for x in leaks_of(doc, index, **OPTIONS)}
        wanted, got, right = wanted + 1, got + len(found), right + (i in found)
    assert right >= 0.97 * wanted and right == got


@pytest.mark.parametrize("block_chars", [2_000_000, 12_000])
def test_the_same_sentences_with_other_names_and_numbers_are_no_leak(spark, block_chars):
    """Two neighbouring sentences of a kind that many items have, in which only names, numbers and a few words differ;
    the item that the document really quotes is found, also with a tenth edited."""
    r = random.Random(3)
    name = lambda: "".join(r.choice("bcdfglmnprstvz") + r.choice("aeiou") for _ in range(4)).capitalize()
    kind, deed = (lambda: r.choice(["lunar", "coastal", "granite", "jagged", "velvet", "amber"])), (lambda: r.choice(["tracked", "folded", "traded", "lifted", "mended", "halved"]))
    told = [
        lambda: f"When {name()} {name()} {deed()} the keeper at close range, the {kind()} stand behind the {r.randrange(10, 99)}-step terrace {deed()}.",
        lambda: f"The groundsman {deed()} {r.randrange(2, 99)} litres of {kind()} paint on lines that {name()} {name()} had {deed()}.",
        lambda: f"In the {kind()} final the ball {deed()} the bar {r.randrange(2, 99)} times before {name()} {name()} scored.",
        lambda: f"Travel from {name()} took {r.randrange(100, 9999)} hours because the {kind()} ferry {deed()}.",
        lambda: f"Half of the {r.randrange(100, 999)} tickets went to {name()}, a third to {name()}, and the rest were {deed()}.",
        lambda: f"A side that {deed()} {r.randrange(2, 99)} of its first {r.randrange(100, 999)} league games then {deed()} in the following {r.randrange(100, 1999)}.",
    ]
    ends = ["Which club held the better record at that point?", "How many games were left undecided?", "Who must have played the longer spell?"]
    # every item begins with the first two kinds; the rest is in any order
    items = [(i, " ".join([told[0](), told[1](), *(f() for f in r.sample(told[2:], 3)), r.choice(ends)]), "") for i in range(60)]
    docs = [(i, f"{text(5000 + i, 40)} {t} {text(6000 + i, 40)}") for i, t, _ in items]
    docs += [(100 + i, f"{text(7000 + i, 40)} {' '.join('quatsch' if n % 10 == 4 else w for n, w in enumerate(t.split()))} {text(8000 + i, 40)}") for i, t, _ in items]
    got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, answer string"), block_chars=block_chars, doc_id="doc_id", text="text", item_id="item_id", item_text="text", item_answer="answer")
    assert sorted((x.doc, x.item) for x in got.collect()) == sorted((d, d % 100) for d, _ in docs)
