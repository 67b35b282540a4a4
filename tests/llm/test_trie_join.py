import random
import re

import numpy as np
import pytest

from parley.llm import trie_join


def _set(text, k):
    ws = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[j : j + k]) for j in range(max(1, len(ws) - k + 1))} if ws else set()


def _components(sets, num, den):
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sets))]


def _family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        ws = list(base)
        for _ in range(rng.randint(0, edits)):
            ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(ws))
    return out


def _texts(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for size, copies, edits in ((20, 6, 2), (60, 25, 3), (200, 8, 8), (5, 4, 1), (120, 12, 12)):
        texts += _family(rng, [word() for _ in range(size)], copies, edits)
    passage = " ".join(word() for _ in range(50))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(20)]
    texts += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(30)]
    texts += [texts[0], texts[0], "", "a b", "A  b", "a"]
    rng.shuffle(texts)
    return texts


def _check(documents, texts, k, num, den):
    rows = trie_join.similar_documents(documents(list(enumerate(texts))), k, num, den).collect()
    sets = [_set(t, k) for t in texts]
    want = _components(sets, num, den)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 4, 5), (1, 1, 2)])
def test_components_match_all_pairs(documents, k, num, den):
    _check(documents, _texts(k), k, num, den)


def test_large_blocks_in_parts(documents, monkeypatch):
    """Blocks above the limit are cut into parts and still lose no link."""
    monkeypatch.setattr(trie_join, "BLOCK", 6)
    monkeypatch.setattr(trie_join, "PIVOTS", 2)
    monkeypatch.setattr(trie_join, "WALKERS", 5)
    monkeypatch.setattr(trie_join, "RUN", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    texts = _family(rng, base, 60, 6) + _family(rng, base[:50] + [f"v{i}" for i in range(40)], 20, 2)
    _check(documents, texts, 4, 85, 100)


def test_long_runs_are_packed_and_opened(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(4)
    sid = np.repeat(rng.integers(1, 2**63, 9).astype(np.uint64), 50)
    h = rng.integers(0, 2**40, 450).astype(np.uint64)
    key = rng.integers(0, 4, 450).astype(np.uint16)
    monkeypatch.setattr(trie_join, "RUN", 5)
    rows = trie_join._cells(key, sid, h)
    got = set()
    for r in rows:
        s, g = trie_join._open(pd.DataFrame([r[1:]], columns=trie_join._NAMES))
        got |= {(r[0], a, b) for a, b in zip(s.tolist(), g.tolist())}
    assert got == set(zip(key.tolist(), sid.tolist(), h.tolist()))


def test_trie_links_connect_what_all_pairs_connect():
    rng = random.Random(11)
    for trial in range(30):
        base = [rng.sample(range(300), rng.randint(3, 60)) for _ in range(4)]
        sets = [set(rng.choice(base)) ^ set(rng.sample(range(300), rng.randint(0, 6))) for _ in range(rng.randint(1, 25))]
        sets = [s | {999} for s in sets]
        for num, den in ((85, 100), (4, 5), (1, 2)):
            want = _components(sets, num, den)
            links = trie_join.trie_links([np.array(sorted(s), np.uint64) for s in sets], np.array([len(s) for s in sets]), num, den)
            up = list(range(len(sets)))

            def top(i):
                while up[i] != i:
                    i = up[i]
                return i

            for a, b in links:
                both = len(sets[a] & sets[b])
                assert den * both >= num * (len(sets[a]) + len(sets[b]) - both)
                x, y = top(a), top(b)
                assert x != y
                up[max(x, y)] = min(x, y)
            assert [top(i) for i in range(len(sets))] == want


def test_many_near_copies_give_few_links():
    rng = random.Random(3)
    base = list(range(500))
    sets = [np.array(sorted(set(base) - set(rng.sample(base, 3)) | {1000 + i}), np.uint64) for i in range(400)]
    assert len(trie_join.trie_links(sets, np.array([len(s) for s in sets]), 85, 100)) == 399


def test_edges(messy, nothing):
    rows = trie_join.similar_documents(messy, 4, 85, 100).collect()
    docs = messy.select("doc_id", "text").collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs)
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    assert sorted(r["n_shingles"] for r in rows) == sorted(len(_set(r["text"], 4)) for r in docs)
    assert trie_join.similar_documents(nothing).count() == 0
