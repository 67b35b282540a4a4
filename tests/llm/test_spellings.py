import random
import re
import zlib
from collections import Counter

import pytest

from parley.llm import spellings


def _near(a, b):
    """Whether one inserted, deleted or replaced letter turns one word into the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _groups(count):
    words = sorted(count)
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 2 * count[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out)


def _count(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            count[low] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def _found(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def _vocabulary(rng, size, letters):
    """Words with neighbours, with common stems, and of few letters, so that grams are heavy."""
    words = set()
    while len(words) < size:
        kind = rng.random()
        w = "".join(rng.choice(letters) for _ in range(rng.choice([5, 5, 6, 7, 8, 10, 14])))
        if kind < 0.3:
            w = "international" + w[: rng.choice([2, 5])]
        elif kind < 0.5:
            w = w[:3] + "ations"
        words.add(w)
        for _ in range(rng.choice([0, 1, 3])):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
            if len(w) >= 5:
                words.add(w)
    return {w: int(rng.paretovariate(0.7)) + 2 for w in sorted(words)}


@pytest.mark.parametrize("many,letters", [(3, "abcdé"), (8, "abcdefghijklmnopqrstuvwxyzàéîöüÿ"), (100, "abcdefgh"), (0, "abc")])
def test_groups_are_brute_force(spark, many, letters):
    count = _vocabulary(random.Random(many), 1200, letters)
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    assert _found(spellings.group_variants(words, many=many)) == _groups(count)


def test_other_alphabets(spark):
    count = {"привет": 9, "привят": 3, "приветы": 4, "日本語日本語": 5, "日本語日本": 2, "aa": 7, "ab": 3, "a": 1}
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    assert _found(spellings.group_variants(words, many=2)) == _groups(count)


def test_from_texts(spark, documents):
    rng = random.Random(4)
    words = list(_vocabulary(rng, 150, "abcdefghiéÀß"))
    rows = [(i, " ".join(rng.choice([w, w.upper(), w.title()]) + rng.choice(["", ",", "7", "×"]) for w in rng.choices(words, k=rng.randrange(60)))) for i in range(300)]
    count = _count(rows)
    assert len(count) > 200
    found = spellings.group_variants(spellings.count_words(documents(rows)))
    assert _found(found) == _groups(count)


def test_edges(spark, messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()] * 3
    docs = messy.union(messy).union(messy)
    assert _found(spellings.group_variants(spellings.count_words(docs))) == _groups(_count(rows))
    assert _found(spellings.group_variants(spellings.count_words(nothing))) == []


def test_a_word_of_a_hundred_thousand_letters(spark, documents):
    long = "".join(random.Random(1).choice("abcdefghij") for _ in range(100_000))
    docs = documents([(1, f"{long} {long} {long} {long}x {long}x {long}x"), (2, "table tables table table tables tables table table table")])
    found = _found(spellings.group_variants(spellings.count_words(docs, slip=None)))
    assert [(len(w), n, near) for w, _, _, n, near, _ in found] == [(100_000, 3, 1), (100_001, 3, 1), (5, 6, 1), (6, 3, 1)]
    assert found[3][:3] == ("tables", "table", "table")
