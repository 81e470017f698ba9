import random

import numpy as np

from tonalis.llm.leakage import BLOCK, RUN, ItemIndex, find_leaks, words

D, I = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def leaks(spark, docs, items):
    df = find_leaks(spark.createDataFrame([(i, t, "") for i, t in docs], D), spark.createDataFrame([(i, t, "") for i, t in items], I))
    return {(r.doc_id, r.item_id): r.palabras for r in df.collect()}


def test_words_fold_case_accents_and_separators():
    assert words("¡Él_dijo: l’ÁRBOL ½ ﬁn!") == ["el", "dijo", "l", "arbol", "1", "2", "fin"]
    assert words(None) == [] and words("") == []


def test_eight_words_leak_and_seven_do_not(spark):
    item = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce"
    docs = [(1, "x " + "DOS, tres-cuatro; CINCO seis siete ocho nuéve"), (2, "dos tres cuatro cinco seis siete ocho y nueve"), (3, None), (4, ""), (5, item), (5, item)]
    assert leaks(spark, docs, [(9, item), (8, "uno dos tres"), (7, None)]) == {(1, 9): 8, (5, 9): 12}


def test_a_run_is_found_wherever_it_lies_in_a_long_text(spark):
    rng = random.Random(1)
    item = " ".join(f"i{k}" for k in range(30))
    for at in (0, 5, 8, 9, 17, 400):
        noise = [f"n{rng.randrange(999)}" for _ in range(500)]
        text = " ".join(noise[:at] + item.split()[3:11] + noise[at:])
        assert leaks(spark, [(1, text)], [(2, item)]) == {(1, 2): 8}, at


def test_empty_tables(spark):
    assert leaks(spark, [], [(1, "a b c d e f g h")]) == {} and leaks(spark, [(1, "a b c d e f g h")], []) == {}


def test_against_brute_force_with_common_words(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(6, 40)))) for k in range(50)]
    docs = []
    for k in range(120):
        text = rng.choices(vocabulary, k=60)
        if k % 3 == 0:
            src = items[rng.randrange(50)][1].split()
            s = rng.randrange(max(1, len(src) - 7))
            text[10:10] = src[s : s + rng.randrange(6, 12)]
        docs.append((k, " ".join(text)))
    want = set()
    for i, t in items:
        w = t.split()
        grams = {tuple(w[j : j + 8]) for j in range(len(w) - 7)}
        for d, u in docs:
            x = u.split()
            if any(tuple(x[j : j + 8]) in grams for j in range(len(x) - 7)):
                want.add((d, i))
    assert set(leaks(spark, docs, items)) == want


def test_thresholds_bound_every_run():
    """The weights of any run of eight words of an item add up to its threshold or more, and its weakest run just reaches it."""
    items = [(1, [f"a{k % 9}" for k in range(40)]), (2, [f"b{k}" for k in range(9)]), (3, [f"a{k}" for k in range(5)] + [f"c{k}" for k in range(30)])]
    index = ItemIndex(items)
    for k, (_, words) in enumerate(items):
        block, place = divmod(k, BLOCK)
        row = lambda w: int(index.rows(block, np.array([index.terms[w]]))[0])
        sums = [sum(index.weight[block][row(w), place] for w in set(words[s : s + RUN])) for s in range(len(words) - RUN + 1)]
        assert min(sums) > 0.999999 and abs(min(sums) - 1) < 1e-9
        assert all(index.bound[index.terms[w], block] >= index.weight[block][row(w), place] - 1e-6 for w in set(words))


def test_a_very_long_text(spark):
    item = " ".join(f"i{k}" for k in range(12))
    text = " ".join(f"n{k % 991}" for k in range(60_000))
    assert leaks(spark, [(1, text + " " + item), (2, text)], [(3, item)]) == {(1, 3): 12}
