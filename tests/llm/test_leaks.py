import random

import pyarrow.parquet as pq
import pytest

from geotrail.llm.leaks import Matcher, budget_and_piece, leaked_passages, myers
from geotrail.llm.registry import p7_edited, p7_found
from geotrail.llm.words import words

ITEM = "The frosted district of Zukichidani borders Godonezawa in the north and Zushichipū in the south while its aqueduct covers 4237 hectares"


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_against_the_plain_table():
    g = random.Random(2)
    for _ in range(1500):
        p, t = ("".join(g.choice("abc ") for _ in range(g.randint(1, n))) for n in (14, 40))
        for most in (0, 1, 3):
            assert myers(p, t, most) == min(edits(p, t), most + 1)


@pytest.mark.parametrize(
    "text",
    [
        "x y THE FROSTED DISTRICT of Zukichidani, borders; Godonezawa - in the north and Zushichipu z",
        "The <b>frost</b>ed dis­trict of Zuki​chidani borders<br/>Godonezawa in&nbsp;the north and Zushichipū",
        "> The frosted dis-\n> trict of Zukichi-\n> dani borders\n> Godonezawa in the north and Zushichipū",
        "Ｔｈｅ frosted **district** of `Zukichidani` borders [Godonezawa] in _the_ north and Zushichipū",
        "<span&nbsp;class=\"q\">The</span> frosted district of Zukichidani borders Godonezawa in the north and Zushichipū",
        "in the south while its aqueduct covers 4237 hectares frosted Zushichipū in the south while its aqueduct covers 4237 hectares",
        ITEM,
    ],
)
def test_layout_makes_no_difference(text):
    found = Matcher([(1, ITEM)], 12, 1).find(text)
    want = any(words(ITEM)[k : k + 12] == words(text)[j : j + 12] for k in range(len(words(ITEM)) - 11) for j in range(len(words(text)) - 11))
    assert (found.get(1) == 0) == want


def test_eleven_words_and_changed_words_are_no_leak():
    w = ITEM.split()
    m = Matcher([(1, ITEM), (2, "just four short words")], 12, 1)
    assert m.find(" ".join(w[2:13])) == {}
    changed = w[:6] + ["Gohidobō"] + w[7:17]
    assert m.find(" ".join(changed)) == {}
    assert m.find(" ".join(reversed(w))) == {}
    assert m.find("some just four short words here") == {2: 0}
    assert m.find("some just four long words here") == {}


def test_one_edit_is_found_within_the_budget_and_marked():
    w = ITEM.split()[:14]
    m = Matcher([(1, ITEM)], 12, 1)
    for k in (0, 5, 13):
        typo = w[:k] + [w[k] + "x"] + w[k + 1 :]
        assert m.find(" ".join(typo[:12] if k < 12 else typo[2:])) == {1: 1}


LONG = "one two abcd cat car golf hotel india juliet kilo lima mike november oscar papa quebec"


@pytest.mark.parametrize(
    "text",
    [
        "one two ab d cat car golf hotel india juliet kilo lima mike",
        "one twoxabcd cat car golf hotel india juliet kilo lima mike",
        "one two abcd car car golf hotel india juliet kilo lima mike",
        "two abcd cat car golfhotel india juliet kilo lima mike november",
        "two abcd cat car golf hotel india juliet kilo limamike november",
        "wo abcd cat car golf hotel india juliet kilo lima mike november",
    ],
)
def test_edits_of_every_kind_lie_within_the_budget(text):
    assert Matcher([(1, LONG)], 12, 1).find(text) == {1: 1}


def within(text, item, need, most):
    """The least distance of any passage by the plain table, or None beyond the budget that the item bears."""
    w, line = words(item), " " + " ".join(words(text)) + " "
    passages = [" " + " ".join(w[k : k + min(need, len(w))]) + " " for k in range(len(w) - min(need, len(w)) + 1)]
    most, _ = budget_and_piece(min(map(len, passages)), most)
    least = min(edits(p, line) for p in passages)
    return least if least <= most else None


@pytest.mark.parametrize("most", [0, 1, 2])
def test_random_edits_against_the_plain_table(most):
    g = random.Random(11 + most)
    found = 0
    for _ in range(700):
        vocabulary = ["".join(g.choice("abc") for _ in range(g.randint(1, 5))) for _ in range(g.choice([3, 30]))]
        item = [g.choice(vocabulary) for _ in range(g.randint(1, 16))]
        need = g.choice([4, 6, 12])
        lo = g.randint(0, max(0, len(item) - need))
        text = list(" ".join(g.choice(vocabulary) for _ in range(g.randint(0, 4))) + " " + " ".join(item[lo : lo + need]) + " " + " ".join(g.choice(vocabulary) for _ in range(g.randint(0, 4))))
        for _ in range(g.randint(0, most + 1)):
            k = g.randrange(len(text) + 1)
            text[k : k + g.choice([0, 1])] = g.choice([[], ["a"], ["b"], [" "], ["x"]])
        text, item = "".join(text), " ".join(item)
        want = within(text, item, need, most) if words(text) else None
        assert Matcher([(5, item)], need, most).find(text) == ({} if want is None else {5: want}), (item, text, need)
        found += bool(want) if most else want == 0
    assert found > 30


def test_many_texts_and_windows_at_once(monkeypatch):
    from geotrail.llm import leaks

    monkeypatch.setattr(leaks, "_WINDOW", 64)
    monkeypatch.setattr(leaks, "_CHUNK", 300)
    g = random.Random(8)
    vocabulary = ["".join(g.choice("abcdef") for _ in range(g.randint(1, 6))) for _ in range(40)]
    items = [(i, " ".join(g.choice(vocabulary) for _ in range(g.randint(5, 40)))) for i in range(30)] + [(99, items_text := "tiny")]
    texts = [None, "", "..."]
    for _ in range(200):
        w = g.choice(items)[1].split()
        lo = g.randint(0, len(w))
        texts.append(" ".join([g.choice(vocabulary) for _ in range(g.randint(0, 30))] + w[lo : lo + g.randint(4, 30)] + [g.choice(vocabulary) for _ in range(g.randint(0, 30))] + ([items_text] if g.random() < 0.1 else [])))
    m = Matcher(items, 6, 1)
    got = m.find_all(texts)
    assert got == [{i: v for i, t in items if words(x) and (v := within(x, t, 6, 1)) is not None} for x in texts] and sum(map(len, got)) > 100


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(12, len(w))
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for n in {len(g) for g in grams} for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def test_whole_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    items = [(r["item_id"], r["item_text"]) for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()]
    got = [tuple(r) for r in p7_found(spark, folder).collect()]
    assert set(got) == brute(docs, items) and len(got) == len(set(got)) > 0
    edited = {(r["doc_id"], r["item_id"]): r["edits"] for r in p7_edited(spark, folder).collect()}
    assert {k for k, v in edited.items() if v == 0} == set(got) and set(edited.values()) <= {0, 1, 2}


def test_nulls_empty_repeats_and_very_long_texts(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, ITEM, 1), (3, ITEM, 1), (4, "filler " * 50_000 + ITEM + " filler" * 50_000, 1)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM, "t"), (8, None, "t"), (None, ITEM, "t"), (9, "...", "t"), (7, ITEM, "t")], "item_id bigint, item_text string, task string")
    assert sorted(map(tuple, leaked_passages(docs, items).collect())) == [(3, 7, 0), (3, 7, 0), (4, 7, 0)]
    assert leaked_passages(docs.limit(0), items).count() == 0 and leaked_passages(docs, items.limit(0)).count() == 0
