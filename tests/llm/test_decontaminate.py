"""Spaced seeds against a comparison of all diagonals."""

import random

import numpy as np
import pytest

from connrisk.llm import decontaminate as D


@pytest.fixture(scope="module")
def items(prose):
    return [(i, " ".join(prose(500 + i, 15 + 2 * i).split())) for i in range(20)] + [(90, "three words only"), (91, None), (92, "  ")]


def substituted(text, part, seed):
    words, rng = text.split(), random.Random(seed)
    for j in rng.sample(range(len(words)), int(part * len(words))):
        words[j] = f"zz{j}"
    return " ".join(words)


def ascii_upper(text):
    return "".join(c.upper() if c.isascii() else c for c in text)


def test_items_with_substitutions_are_found(llm, prose, items):
    planted = {}
    rows = [(1000 + i, prose(i, 60)) for i in range(40)] + [(5000, None), (5001, ""), (None, items[3][1])]
    for n, (i, text) in enumerate((i, t) for i, t in items[:20] for _ in range(3)):
        planted[n] = i
        rows.append((n, prose(900 + n, 30) + "\n" + ascii_upper(substituted(text, 0.1 * (n % 3), n)) + " " + prose(700 + n, 20)))
    df = llm.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, item_id long").repartition(4)
    bench = llm.createDataFrame(items, "item_id long, text string")
    found = D.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {*planted.items(), (None, 3)}
    assert all(100 * r.n_equal >= 80 * r.n_words for r in found)
    several = D.find_leaks(df, bench, block_bytes=500).collect()
    assert sorted(map(str, several)) == sorted(map(str, found))
    kept = D.drop_contaminated(df, bench, block_bytes=500)
    assert kept.schema == df.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i is not None and i not in planted}


def test_short_items_need_all_their_words(llm):
    bench = llm.createDataFrame([(90, "three words only")], "item_id long, text string")
    df = llm.createDataFrame([(1, "here are Three words\nONLY indeed"), (2, "three words and only"), (3, "three words only")], "doc_id long, text string")
    assert sorted((r.doc_id, r.start_word, r.n_words) for r in D.find_leaks(df, bench).collect()) == [(1, 2, 3), (3, 0, 3)]


def every_diagonal(text, item):
    """Whether some alignment of the item has a similar stretch that counts."""
    own, target = ascii_upper(text).split(), ascii_upper(item).split()
    for d in range(-len(target) + 1, len(own)):
        low, high = max(0, -d), min(len(target), len(own) - d)
        equal = np.array([own[d + j] == target[j] for j in range(low, high)], bool)
        a, b = D.longest_similar(equal, 80)
        if int(equal[a:b].sum()) >= min(10, -(-80 * len(target) // 100)) > 0:
            return True
    return False


@pytest.mark.parametrize("n", range(1, 10))
def test_every_single_substitution_that_the_rule_admits(llm, n):
    words = [f"w{j}" for j in range(n)]
    rows = [(j, " ".join(["x", *words[:j], "zz", *words[j + 1 :], "y"])) for j in range(n)] + [(100, "x " + " ".join(words)), (101, "x y z")]
    rows += [(200 + j, " ".join(words[:j] + words[j + 1 :])) for j in range(n)]
    block = D.Block([(7, " ".join(words).encode())])
    found = {rows[leak[0]][0] for leak in block.leaks([t.encode() for _, t in rows])}
    assert found == {i for i, t in rows if every_diagonal(t, " ".join(words))}
    assert 100 in found and (n < 5 or set(range(n)) <= found)


def test_words_with_equal_polynomials_are_not_taken_for_one_another():
    one, two = ("".join(letters[bin(i).count("1") & 1] for i in range(1024)) for letters in ("ab", "ba"))
    assert not D.Block([(1, one.encode())]).leaks([two.encode()]) and D.Block([(1, one.encode())]).leaks([one.encode()])


def test_longest_similar_stretch():
    rng = np.random.default_rng(0)
    for _ in range(500):
        e = rng.random(int(rng.integers(0, 25))) < 0.7
        good = [(b - a) for a in range(len(e)) for b in range(a + 1, len(e) + 1) if 100 * e[a:b].sum() >= 80 * (b - a)]
        a, b = D.longest_similar(e, 80)
        assert (a, b) == (0, 0) if not good else e[a] and e[b - 1] and 100 * e[a:b].sum() >= 80 * (b - a)


def test_empty_tables(llm, no_docs, null_docs):
    bench = llm.createDataFrame([], "item_id long, text string")
    assert D.find_leaks(null_docs, bench).count() == 0
    assert D.drop_contaminated(null_docs, bench).count() == 4
    some = llm.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    assert D.find_leaks(no_docs, some).count() == 0
    assert D.drop_contaminated(null_docs, some).count() == 4
