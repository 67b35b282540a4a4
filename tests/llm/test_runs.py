import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from parley.llm import runs


def _brute(x, least=0):
    """(start, end, period) of all runs, by comparing every place with every period."""
    n, out = len(x), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if x[i] != x[i + p]:
                i += 1
                continue
            b = i
            while i + p < n and x[i] == x[i + p]:
                i += 1
            if i - b >= p:
                out.setdefault((b, i + p), p)
    return sorted((b, e, p) for (b, e), p in out.items() if e - b >= least)


def _line(rng):
    """A line made of repeats, repeats of repeats, powers that are out of step, and noise."""
    letters = rng.choice([2, 2, 3, 5])
    x = []
    while len(x) < rng.choice([30, 120, 400]):
        kind = rng.random()
        root = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 9, 14, 30]))]
        if kind < 0.3:
            x += root * rng.randrange(2, 9)
        elif kind < 0.5:
            part = root * rng.randrange(3, 12) + root[: rng.randrange(len(root) + 1)]
            x += (part + [rng.randrange(letters)] * rng.randrange(2)) * rng.randrange(2, 4)
        elif kind < 0.7:
            x += x[-rng.randrange(1, 60) :] * rng.randrange(1, 3)
        else:
            x += root
    return x[:500]


@pytest.mark.parametrize("seed", range(6))
def test_all_runs(seed):
    rng = random.Random(seed)
    for _ in range(150):
        x = _line(rng)
        assert sorted(map(tuple, runs.find_runs(np.array(x)).tolist())) == _brute(x)


def test_words_that_defeat_sums():
    x = [0]
    while len(x) < 1024:  # its halves have equal polynomial sums in any odd base
        x += [1 - c for c in x]
    assert sorted(map(tuple, runs.find_runs(np.array(x)).tolist())) == _brute(x)
    fib = "a"
    last = "b"
    while len(fib) < 600:
        fib, last = fib + last, fib
    x = [ord(c) for c in fib]
    assert sorted(map(tuple, runs.find_runs(np.array(x)).tolist())) == _brute(x)


def test_wrong_hashes_are_mended():
    line = runs.Line(np.array([1, 2, 1, 2, 9, 2, 1, 2, 1, 2]))
    assert line.checked(0, 10, 2, 0) == (0, 4)
    assert line.checked(0, 10, 2, 5) == (5, 10)


def _expected(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(b"" if doc is None else str(doc).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted((b, e - b, p) for b, e, p in _brute(words, 12))
    gone = {i for b, size, p in found for i in range(b + p, b + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    return (
        doc, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def _query(docs):
    out = runs.digests(runs.collapse_runs(docs, runs.plant_repeats))
    return sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=repr)


def test_query_is_brute_force(spark, documents):
    rng = random.Random(11)
    rows = []
    for i in range(250):
        words = [rng.choice(["do", "re", "Re", "mié"]) for _ in range(rng.choice([0, 1, 5, 20, 60, 200]))]
        words = [*words, *(words[-7:] * rng.randrange(4))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    assert _query(documents(rows)) == sorted((_expected(*r) for r in rows), key=repr)


def test_edges(spark, messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    short = [r for r in rows if len(r[1] or "") < 10_000]
    assert _query(messy.where("coalesce(length(text), 0) < 10000")) == sorted((_expected(*r) for r in short), key=repr)
    assert messy.count() == len(_query(messy))
    assert _query(nothing) == []


def test_one_long_period(spark, documents):
    words = [f"w{i}" for i in range(20_000)]
    text = " ".join([*words, *words, "w0"])
    out = runs.collapse_runs(documents([(1, text), (2, "a " * 50_000)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in out[0]["runs"]] == [(0, 40_001, 20_000)] and out[0]["collapsed"] == " ".join(words)
    assert [tuple(r) for r in out[1]["runs"]] == [(0, 50_000, 1)] and out[1]["collapsed"] == "a"
