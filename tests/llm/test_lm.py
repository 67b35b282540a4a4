import collections
import math
import re
import sys
import zlib

import numpy as np

from parley.llm import lm


def _tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0d]+", text or "")] + [None]


def _held(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2


def _check(rows, got):
    counts = collections.Counter(t for i, x in rows if not _held(i) for t in _tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, x in rows:
        ts = _tokens(x)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)
        want.append((str(i), _held(i), len(ts), sum(counts[t] > 0 for t in ts), n, round(base, 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)


def test_counts_and_base_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lm.score_by_id(docs).collect()
    _check([(r["doc_id"], r["text"]) for r in docs.collect()], got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_better_than_counts_on_held_out_texts(spark):
    got = lm.score_by_id(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").groupBy().sum("base_score", "score").first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_all_outcomes_sum_to_one():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**63, 3000).astype(np.uint64)
    h[0] = lm.END_HASH
    tail, c = rng.integers(0, lm.TAILS, 3000), rng.integers(1, 500, 3000)
    masses = np.bincount(tail[1:], c[1:] + 1, lm.TAILS)
    v = lm.Vocabulary(h, tail, c, masses, int(c.sum()), 3000)
    model = lm.Model(v)
    z = model.predict(rng.integers(0, lm.CLASSES, (1, lm.CONTEXT))) @ model.out[:, : lm.DIM].T + model.out[:, lm.DIM]
    p = np.exp(z - z.max())[0]
    p /= p.sum()
    heads = set(sorted(range(1, 3000), key=lambda i: (-c[i], h[i]))[: lm.HEADS])
    total = p[: lm.HEADS + 1].sum() + sum(p[lm.HEADS + 1 + k] / v.mass[lm.HEADS + 1 + k] for k in range(lm.TAILS))
    for i in range(1, 3000):
        if i not in heads:
            cls = lm.HEADS + 1 + tail[i]
            total += p[cls] * (c[i] + 1) / v.mass[cls]
    assert abs(total - 1) < 1e-6


def test_training_lifts_the_likelihood_of_a_pattern():
    rng = np.random.default_rng(2)
    h = np.append(rng.integers(1, 2**63, 40).astype(np.uint64), lm.END_HASH)
    v = lm.Vocabulary(h, np.zeros(41, np.int64), np.full(41, 100), np.zeros(lm.TAILS), 4100, 41)
    model = lm.Model(v)
    target = np.tile(np.arange(10), 4000)
    ctx = np.stack([np.roll(target, i + 1) + i * (lm.CLASSES + 1) for i in range(lm.CONTEXT)], 1)
    lm.descend(model, ctx, target, np.zeros_like(model.w), rng)
    z = model.predict(ctx[:100]) @ model.out[:, : lm.DIM].T + model.out[:, lm.DIM]
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert p[np.arange(100), target[:100]].mean() > 0.2  # about 0.02 before


def test_edges(messy, nothing):
    _check([(r["doc_id"], r["text"]) for r in messy.collect()], lm.score_by_id(messy).collect())
    assert lm.score_by_id(nothing).count() == 0


def test_words_outside_the_classes_learn_from_their_contexts(documents):
    """Two pairs of words with one ending, in a fixed order; the ends traded, counts and classes stay the same."""
    rng = np.random.default_rng(3)
    filler = [f"f{i:03d}" for i in range(lm.HEADS + 20)]
    pairs = [("wardzz", "stepzz"), ("bellzz", "sandzz")]
    train = []
    for i in range(2000):
        ws = list(rng.choice(filler, 24))
        ws[5:7], ws[15:17] = pairs[i % 2], pairs[(i + 1) % 2]
        train.append((i, " ".join(ws)))
    probes = [(10_000 + i, " ".join([*filler[:9], a, b, *filler[9:12]])) for i, (a, b) in enumerate([*pairs, ("wardzz", "sandzz"), ("bellzz", "stepzz")])]
    docs = documents(train + probes)
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, docs["doc_id"] >= 10_000).where("held_out").collect()}
    right, wrong = got[10_000] + got[10_001], got[10_002] + got[10_003]
    assert right - wrong > 0.5  # 0 when a word is its class and its count


def test_groups_and_words_sum_to_one():
    rng = np.random.default_rng(4)
    h = rng.integers(1, 2**63, 3000).astype(np.uint64)
    h[0] = lm.END_HASH
    tail, c = rng.integers(0, lm.TAILS, 3000), rng.integers(1, 500, 3000)
    v = lm.Vocabulary(h, tail, c, np.bincount(tail[1:], c[1:] + 1, lm.TAILS), int(c.sum()), 3000)
    model = lm.Model(v)
    model.x += rng.normal(0, 0.3, model.x.shape).astype(np.float32)
    own = np.append(np.arange(model.words), np.full(lm.TAILS, model.none))
    kind = np.append([np.searchsorted(v.first_group, v.group[i], "right") - 1 for i in range(model.words)], np.arange(lm.TAILS))
    q = np.tile(rng.normal(0, 1, lm.DIM).astype(np.float32), (len(own), 1))
    lp, _ = lm.lower(model, v, q, (lm.END + 1 + kind).astype(np.int64), own)
    assert model.words > 2500 and np.allclose(np.bincount(kind.astype(int), np.exp(lp), lm.TAILS), 1, atol=1e-5)


def test_words_of_one_slot_keep_their_vectors():
    rng = np.random.default_rng(6)
    h = np.unique(rng.integers(1, 2**63, 5000).astype(np.uint64) & np.uint64((1 << 44) - 1) | (rng.integers(0, 40, 5000).astype(np.uint64) << np.uint64(44)))
    h[-1] |= np.uint64(0xFFFFF) << np.uint64(44)  # the last slot, and one after it
    h = np.append(np.append(h, h[-1] ^ np.uint64(1)), lm.END_HASH)
    c = rng.integers(1, 500, len(h))
    v = lm.Vocabulary(h, np.zeros(len(h), np.int64), c, np.zeros(lm.TAILS), int(c.sum()), len(h))
    slot = v.find(h)
    assert (slot >= 0).all() and len(set(slot.tolist())) == len(h) and (v.key[slot] == h).all()
    assert np.allclose(v.count[slot], np.log10(c + 1)) and len(v.group) == len(h) - 1 - lm.HEADS
    assert (v.find(rng.integers(1, 2**63, 20_000).astype(np.uint64) & np.uint64((1 << 50) - 1)) < 0).mean() > 0.99


def _tree(seed, words=3000):
    """A vocabulary without texts, its model with vectors of some size, and the kind of every word's class."""
    rng = np.random.default_rng(seed)
    h = np.append(rng.integers(1, 2**63, words).astype(np.uint64), lm.END_HASH)
    tail, c = rng.integers(0, lm.TAILS, words + 1), rng.integers(1, 500, words + 1)
    v = lm.Vocabulary(h, tail, c, np.bincount(tail[:-1], c[:-1] + 1, lm.TAILS), int(c.sum()), words + 1)
    model = lm.Model(v)
    model.x[: model.none] += rng.normal(0, 0.3, model.x[: model.none].shape).astype(np.float32)
    return rng, v, model, np.searchsorted(v.first_group, v.group, "right") - 1


def test_words_of_many_groups_are_taken_together():
    """50,000 tokens over 20,000 words: what is called follows the tokens, not the groups they fall into."""
    rng, v, model, kind = _tree(7, 20_000)
    own = rng.integers(0, model.words, 50_000)
    q = rng.normal(0, 1, (len(own), lm.DIM)).astype(np.float32)
    for gains in (None, lm.Gains(model)):
        calls = []
        sys.setprofile(lambda frame, event, arg: calls.append(1) if event in ("call", "c_call") else None)
        try:
            lm.lower(model, v, q, lm.END + 1 + kind[own], own, gains)
        finally:
            sys.setprofile(None)
        assert len(calls) < 6000


def test_softmaxes_taken_together_are_those_of_each_token():
    """Groups with one token, a few, and more than are taken together; words without vectors; scores that need a shift."""
    rng, v, model, kind = _tree(8)
    model.x[: model.words : 7, -1] += 200
    own = np.concatenate([rng.integers(0, model.words, 700), np.full(lm.FEW + 40, 5), rng.integers(0, 40, 300), np.full(20, model.none)])
    kinds = np.append(kind, 0)[np.minimum(own, model.words)]
    kinds[-20:] = rng.integers(0, lm.TAILS, 20)
    q = rng.normal(0, 1, (len(own), lm.DIM)).astype(np.float32)
    q1, x = np.append(q, np.ones((len(q), 1)), 1), model.x[:, lm.DIM :].astype(float)
    lp, slope, grad = np.zeros(len(own)), np.zeros((len(own), lm.DIM)), np.zeros_like(x)
    for i, k in enumerate(kinds):
        last = v.first_group[k + 1] - 1
        group = v.group[own[i]] if own[i] < model.words else last
        steps = [(v.first_group[k] + model.words, last + 1 + model.words, group + model.words)]
        if own[i] < model.words:
            steps.append((v.first_word[group], v.first_word[group + 1], own[i]))
        for a, b, pick in steps:
            z = x[a:b] @ q1[i]
            p = np.exp(z - z.max())
            p /= p.sum()
            lp[i] += z[pick - a] - z.max() - np.log(np.exp(z - z.max()).sum())
            push = -p
            push[pick - a] += 1
            slope[i] += push @ x[a:b, : lm.DIM]
            grad[a:b] += push[:, None] * q1[i]
    assert np.allclose(lm.lower(model, v, q, lm.END + 1 + kinds, own)[0], lp, atol=1e-3)
    got, dq = lm.lower(model, v, q, lm.END + 1 + kinds, own, lm.Gains(model))
    assert np.allclose(got, lp, atol=1e-3) and np.allclose(dq, slope, atol=1e-3)
    assert np.allclose(model.x[:, lm.DIM :], x + lm.RATE * grad / np.sqrt(1 + grad**2), atol=1e-3)
    assert not model.x[model.none].any()


def test_words_of_contexts_are_read_and_moved_inside_their_text(monkeypatch):
    """Texts of 0 to 40 words in parts of 50 tokens and batches of 16, against a loop over tokens and positions."""
    monkeypatch.setattr(lm, "CHUNK", 50)
    monkeypatch.setattr(lm, "BATCH", 16)
    rng, v, model, kind = _tree(9)
    sizes = rng.integers(0, 41, 12) * (np.arange(12) != 4)
    own = np.concatenate([np.append(rng.integers(0, 60, n), model.none) for n in sizes])
    target = np.where(own < model.words, lm.END + 1 + np.append(kind, 0)[np.minimum(own, model.words)], lm.END)
    since = np.concatenate([np.arange(n + 1) for n in sizes])
    past = [np.where(since > i, np.roll(target, i + 1), lm.CLASSES) + i * (lm.CLASSES + 1) for i in range(lm.CONTEXT)]
    ctx = np.stack(past, 1)
    other, copies = lm.Model(v), [lm.Gains(model) for _ in range(2)]
    other.w, other.x = model.w.copy(), model.x.copy()
    squares = [np.zeros_like(model.w) for _ in range(2)]
    lm.learn(model, v, ctx, target, own, since, squares[0], copies[0], np.random.default_rng(1))
    draws, parts = np.random.default_rng(1), -(-len(own) // 50)
    for p in range(parts):
        s, e = len(own) * p // parts, len(own) * (p + 1) // parts
        pairs = [(t, i, own[t - i - 1]) for t in range(s, e) for i in range(lm.CONTEXT) if since[t] > i and own[t - i - 1] < model.words]
        extra, x = np.zeros((e - s, lm.DIM), np.float32), other.x[:, : lm.DIM].copy()
        for t, i, word in pairs:
            extra[t - s] += x[word] * x[other.positions + i]
        assert np.allclose(other.inputs(own, since)[s:e], extra, atol=1e-4)
        q, dq = lm.descend(other, ctx[s:e], target[s:e], squares[1], draws, extra)
        dq = dq + lm.lower(other, v, q, target[s:e], own[s:e], copies[1])[1]
        grad = np.zeros_like(x)
        for t, i, word in pairs:
            grad[word] += dq[t - s] * x[other.positions + i]
            grad[other.positions + i] += dq[t - s] * x[word]
            copies[1].moved[word, 0] += 1
        copies[1].moved[other.positions : other.none, 0] += e - s
        copies[1].squares[:, : lm.DIM] += grad * grad
        other.x[:, : lm.DIM] += lm.RATE * grad / np.sqrt(copies[1].squares[:, : lm.DIM])
    assert parts > 3 and np.allclose(model.x, other.x, atol=1e-3) and np.allclose(model.w, other.w, atol=1e-3)
    assert np.array_equal(copies[0].moved, copies[1].moved)
