"""Log-bilinear language model with noise-contrastive training; token probabilities.

Tokens are words, and one end token a text. A word is reached in three steps,
each a softmax given the context. First one of ``CLASSES`` classes: the most
frequent words and the end token alone, all other words by a hash of their last
two bytes. Then a group inside the class: its words in the table of frequent
words, cut by frequency into groups of ``GROUP``, and one group of all others.
Then the word inside the group. Words of the last group share its probability by
add-one counts with one unknown word a class: all outcomes sum to 1.

A context predicts ``q = sum (C_i c_i + d_i * r_i)``: a vector for the class of
each of ``CONTEXT`` words (one table a position) and one for the word itself,
weighed by position. An outcome scores ``q . v + b``; classes, groups and words of
the table have their own ``v`` and ``b``. Training is one pass over all training
texts: each task descends on its own rows from the same start, on classes with
noise drawn from class frequencies and shared by a batch, on groups and words with
the exact gradient of their small softmaxes. The tasks' tables are averaged in
Spark, row by row: classes by tokens, words by the tokens that moved them.

Counts cover every training token. Words occur too often in a kind to be sent
anywhere whole, so: a table of the most frequent words (``FREQUENT`` slots at
most, whatever the corpus) goes to every task; the other words leave a document
as (hash, times) and are joined with their counts, summed a document.

Defined cases: a null text is empty (only the end token); a null id is a
training row that is not held out; repeated rows are scored each; without
training rows every class is as likely as any other; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import remainder
from .words import mix, slices, words

HEADS = 31  # words with a class of their own
TAILS = 32  # classes of all other words
CLASSES = HEADS + 1 + TAILS
END = HEADS
CONTEXT = 3
DIM = 24
NOISE = 32
BATCH = 4096
RATE = 0.15
FREQUENT = 1 << 17
SLOTS = 1 << 20
GATHER = 3_000_000
GROUP = 64  # words of a class that share a softmax
CHUNK = 1 << 17  # tokens between two updates of word vectors
STEP = 1024  # tokens of one softmax between two updates
FEW = 256  # tokens of one softmax at most that are taken together with those of others
STACK = 4096  # tokens that are taken together
SAFE = 60  # scores up to this, and chosen ones down to minus this, need no shift before exp
WIDE = 512  # tokens scored at once over all classes
BLOCK = 256  # table rows sent together
END_HASH = mix(np.array([0xE0D], np.uint64))[0]


def _tail(w, start, end) -> np.ndarray:
    """Class among ``TAILS`` by a word's last two bytes."""
    last = w.data[end - 1].astype(np.int64)
    before = np.where(end - start > 1, w.data[np.maximum(end - 2, 0)], 0).astype(np.int64)
    return (last * 31 + before * 7) % TAILS


COUNTS = "h long, tail int, c long"


def _alike(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal hashes together, and where each begins in it."""
    order = np.argsort(h)
    value = h[order]
    return order, np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(h) else np.zeros(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]):
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def reduce():
        h, t, c = (np.concatenate(x) for x in zip(*held))
        order, head = _alike(h)
        return h[order[head]], t[order[head]], np.add.reduceat(c[order], head)

    def batch(h, t, c):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t.astype(np.int32)), pa.array(c)], ["h", "tail", "c"])

    size = 0
    for b in slices(batches, "text"):
        w = words(b.column("text"))
        order, head = _alike(w.hash)
        first, times = order[head], np.diff(np.append(head, len(order)))
        value = w.hash[first]
        held.append((value, _tail(w, w.start[first], w.end[first]), times))
        held.append((np.array([END_HASH]), np.zeros(1, np.int64), np.array([b.num_rows])))
        size += len(value)
        if size > GATHER:
            held = [reduce()]
            size = len(held[0][0])
            if size > GATHER // 2:
                yield batch(*held[0])
                held, size = [], 0
    if held:
        yield batch(*reduce())


def count_words(docs: DataFrame) -> DataFrame:
    """Times of every word of all texts, by hash; the end token counts once a text."""
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, COUNTS)
    return parts.groupBy("h").agg(F.max("tail").alias("tail"), F.sum("c").alias("c"))


class Vocabulary:
    """The frequent words in a table of slots, and what the classes weigh."""

    def __init__(self, h, tail, c, masses, total, kinds):
        order = np.lexsort((h, -c))
        h, tail, c = h[order], tail[order], c[order]
        head = np.flatnonzero(h != END_HASH)[:HEADS]
        cls = (HEADS + 1 + tail).astype(np.int16)
        cls[head] = np.arange(len(head))
        cls[h == END_HASH] = END
        mass = np.zeros(CLASSES)
        mass[HEADS + 1 :] = masses + 1  # and the unknown word
        np.subtract.at(mass, HEADS + 1 + tail[head], c[head] + 1)
        mass[: len(head)] = c[head] + 1
        ends = c[h == END_HASH]
        mass[END] = (ends[0] if len(ends) else 0) + 1
        self.key = np.zeros(SLOTS, np.uint64)
        self.cls = np.full(SLOTS, -1, np.int16)
        self.count = np.zeros(SLOTS)
        slot = (h >> np.uint64(44)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):  # words of one slot take the next free ones
            _, one = np.unique(slot[left], return_index=True)
            put = left[one][self.cls[slot[left[one]]] < 0]
            self.key[slot[put]], self.cls[slot[put]] = h[put], cls[put]
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) % SLOTS
        self.count[slot] = np.log10(c + 1)
        self.mass = mass
        own = np.flatnonzero(cls > END)
        own = own[np.argsort(cls[own], kind="stable")]  # by class, the frequent first
        kind = cls[own].astype(np.int64) - END - 1
        each = np.bincount(kind, minlength=TAILS)
        self.first_group = np.append(0, np.cumsum(-(-each // GROUP) + 1))
        place = np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each)
        self.group = self.first_group[kind] + place // GROUP
        self.groups = int(self.first_group[-1])
        self.first_word = np.searchsorted(self.group, np.arange(self.groups + 1))
        self.word = np.full(SLOTS, len(own), np.int32)  # beyond the last: none
        self.word[slot[own]] = np.arange(len(own))
        self.word_mass = (c[own] + 1).astype(float)
        self.rest = np.maximum(mass[END + 1 :] - np.bincount(kind, self.word_mass, TAILS), 1)
        self.group_mass = np.bincount(self.group, self.word_mass, self.groups)
        self.group_mass[self.first_group[1:] - 1] = self.rest
        self.total, self.kinds = total, kinds
        self.end_count = ends[0] if len(ends) else 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of every word, or -1."""
        slot = (hashes >> np.uint64(44)).astype(np.int64)
        open_ = np.flatnonzero(self.key[slot] != hashes)
        while len(open_):
            open_ = open_[self.cls[slot[open_]] >= 0]  # a free slot ends the search
            slot[open_] = (slot[open_] + 1) % SLOTS
            open_ = open_[self.key[slot[open_]] != hashes[open_]]
        return np.where((self.cls[slot] >= 0) & (self.key[slot] == hashes), slot, -1)

    def classes(self, w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot or -1, class, row of the word in the table of vectors) of every word."""
        slot = self.find(w.hash)
        hit = slot >= 0
        cls = np.where(hit, self.cls[slot], HEADS + 1 + _tail(w, w.start, w.end)).astype(np.int64)
        return slot, cls, np.where(hit, self.word[slot], len(self.group)).astype(np.int64)


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    """From the table of counts; only bounded aggregates and the frequent words come back."""
    end = int(np.array([END_HASH]).view(np.int64)[0])
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    masses = np.zeros(TAILS)
    for r in counts.where(F.col("h") != end).groupBy("tail").agg(F.sum(F.col("c") + 1).alias("m")).collect():
        masses[r["tail"]] = r["m"]
    level = F.floor(F.log2("c") * 8)
    steps = sorted(counts.groupBy(level.alias("s")).count().collect(), key=lambda r: -r["s"])  # a few hundred
    room, least = FREQUENT, 1 << 62
    for r in steps:
        room -= r["count"]
        if room < 0:
            break
        least = r["s"]
    rows = counts.where((level >= least) | (F.col("h") == end)).toPandas()
    return Vocabulary(
        rows["h"].to_numpy(np.int64).view(np.uint64), rows["tail"].to_numpy(np.int64), rows["c"].to_numpy(np.int64),
        masses, int(total["n"] or 0), int(total["v"] or 0),
    )


class Model:
    """Context vectors, class vectors and biases as one matrix, those of words and groups as another.

    Rows of ``x`` are the words, the groups, one weight vector a position and an
    empty row for no word; its columns the input vector, the output vector and the bias.
    """

    ROWS = (CONTEXT + 1) * (CLASSES + 1)  # the last class of a context table is the text's start

    def __init__(self, vocab: Vocabulary):
        rng = np.random.Generator(np.random.PCG64(20240))
        self.w = rng.normal(0, 0.1, (self.ROWS, DIM + 1)).astype(np.float32)
        self.w[:, DIM] = 0
        p = np.maximum(vocab.mass, 0.5)
        self.noise = p / p.sum()
        self.w[CONTEXT * (CLASSES + 1) :][:CLASSES, DIM] = np.log(self.noise)
        n = len(vocab.group)
        self.words, self.positions, self.none = n, n + vocab.groups, n + vocab.groups + CONTEXT
        self.x = np.zeros((self.none + 1, 2 * DIM + 1), np.float32)
        self.x[:n, -1] = np.log(vocab.word_mass)
        self.x[n : self.positions, -1] = np.log(vocab.group_mass)
        self.x[self.positions : self.none, :DIM] = 1

    @property
    def out(self) -> np.ndarray:
        return self.w[CONTEXT * (CLASSES + 1) :][:CLASSES]

    def classes(self, ctx: np.ndarray) -> np.ndarray:
        """What the classes of the contexts predict, and a zero for the bias."""
        q = np.take(self.w, ctx[:, 0], axis=0)
        for i in range(1, CONTEXT):
            q += np.take(self.w, ctx[:, i], axis=0)
        return q

    def predict(self, ctx: np.ndarray) -> np.ndarray:
        return self.classes(ctx)[:, :DIM]

    def inputs(self, own: np.ndarray, since: np.ndarray) -> np.ndarray:
        """What the words before each token add to ``predict``; each word's vector is read once."""
        q = np.zeros((len(own), DIM), np.float32)
        for s in range(0, len(own), BATCH):
            a, e = max(0, s - CONTEXT), min(s + BATCH, len(own))
            each = self.x[own[a:e], :DIM]
            for i in range(CONTEXT):
                b = max(s, i + 1)
                past = each[b - i - 1 - a : e - i - 1 - a] * self.x[self.positions + i, :DIM]
                past[since[b:e] <= i] = 0  # of another text
                q[b:e] += past
        return q


def _stream(w, cls: np.ndarray, word: np.ndarray, none: int):
    """(contexts as table rows, targets, words, places in the text) of all tokens, the end tokens included."""
    target, own = np.insert(cls, w.first[1:], END), np.insert(word, w.first[1:], none)
    begin = w.first[:-1] + np.arange(len(w.first) - 1)
    since = np.arange(len(target)) - np.repeat(begin, np.diff(np.append(begin, len(target))))
    ctx = np.empty((len(target), CONTEXT), np.int64)
    for i in range(CONTEXT):
        past = np.full(len(target), CLASSES)
        past[i + 1 :] = target[: len(target) - i - 1]
        past[since <= i] = CLASSES
        ctx[:, i] = past + i * (CLASSES + 1)
    return ctx, target, own, since


def descend(
    model: Model, ctx: np.ndarray, target: np.ndarray, squares: np.ndarray, rng, extra: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """One pass of noise-contrastive estimation, in place, with adaptive rates.

    ``extra`` is added to the predictions; the result is these and their gradient.
    """
    asked, moves = np.empty((2, len(target), DIM), np.float32)
    base = CONTEXT * (CLASSES + 1)
    w, ln_kp = model.w, np.log(NOISE * model.noise).astype(np.float32)
    cum = np.cumsum(model.noise)
    cells = np.arange(DIM + 1)
    for s in range(0, len(target), BATCH):
        c, t = ctx[s : s + BATCH], target[s : s + BATCH]
        q1 = model.classes(c)
        if extra is not None:
            q1[:, :DIM] += extra[s : s + BATCH]
        q1[:, DIM] = 1
        asked[s : s + BATCH] = q1[:, :DIM]
        noise = np.minimum(np.searchsorted(cum, rng.random(NOISE)), CLASSES - 1)
        vt, vn = np.take(w, base + t, axis=0), w[base + noise]
        pos = np.einsum("nd,nd->n", q1, vt) - ln_kp[t]
        gn = q1 @ vn.T
        gn -= ln_kp[noise]
        gp = 1 / (1 + np.exp(np.clip(pos, -30, 30)))  # towards the data
        np.exp(np.clip(np.negative(gn, out=gn), -30, 30, out=gn), out=gn)
        gn += 1
        np.divide(-1, gn, out=gn)  # away from the noise
        dq = gn @ vn
        dq += gp[:, None] * vt
        dq[:, DIM] = 0
        moves[s : s + BATCH] = dq[:, :DIM]
        grad = np.zeros_like(w)
        np.add.at(grad, base + noise, gn.T @ q1)
        q1 *= gp[:, None]
        flat = grad.reshape(-1)
        np.add.at(flat, ((base + t)[:, None] * (DIM + 1) + cells).ravel(), q1.ravel())
        for i in range(CONTEXT):
            np.add.at(flat, (c[:, i, None] * (DIM + 1) + cells).ravel(), dq.ravel())
        grad /= len(t)
        squares += grad * grad
        w += RATE * grad / (np.sqrt(squares) + 1e-4)
    return asked, moves


class Gains:
    """Sums of squared gradients of ``x``, and how many tokens moved the inputs and outputs of its rows."""

    def __init__(self, model: Model):
        self.squares = np.ones_like(model.x)
        self.moved = np.zeros((len(model.x), 2), np.float32)


def _softmax(z: np.ndarray, own: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """``exp(z)`` in place, its sums along ``axis``, and the log-probabilities of what scores ``own``."""
    if len(own) and (z.max() > SAFE or own.min() < -SAFE):
        top = z.max(axis, keepdims=True)
        z -= top
        own = own - top.ravel()
    np.exp(z, out=z)
    total = z.sum(axis, keepdims=True)
    return total, own - np.log(total.ravel())


def _choose(model: Model, q, tokens, key, bounds, pick, gains: Gains | None, lp, dq) -> None:
    """Adds for ``tokens`` the log-probability of row ``pick`` among those from ``bounds[key]`` to ``bounds[key + 1]``.

    Tokens that choose among the same rows are taken together, few of them with
    those of others as one stack of products; with ``gains`` the rows move and
    the gradient of ``q`` is added to ``dq``.
    """
    width = np.diff(bounds)
    order = np.argsort(key.astype(np.min_scalar_type(len(bounds))), kind="stable")
    each = np.bincount(key, minlength=len(width))
    if (each[width < 2] > 0).any():  # one row is certain
        order, each = order[width[key[order]] > 1], np.where(width > 1, each, 0)
    pieces = -(-each // STEP)
    kind = np.repeat(np.arange(len(width)), pieces)
    nth = np.arange(len(kind)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.append((np.cumsum(each) - each)[kind] + nth * STEP, len(order))
    sizes, starts, ends = np.diff(cuts), bounds[kind], bounds[kind + 1]
    tokens, pick = tokens[order], pick[order] - np.repeat(starts, sizes)
    q1 = np.ones((len(order), DIM + 1), np.float32)
    q1[:, :DIM] = np.take(q, tokens, axis=0)
    won, slope = np.zeros(len(order)), None if gains is None else np.empty((len(order), DIM), np.float32)
    few = (sizes <= FEW) & (ends - starts <= GROUP) & (pieces[kind] == 1)  # one update a row at a time
    small = np.flatnonzero(few)
    small = small[np.argsort(sizes[small], kind="stable")]
    s = 0
    while s < len(small):  # softmaxes of about as many tokens, the fewer filled up with zeros
        least = int(sizes[small[s]])
        same = int(np.searchsorted(sizes[small], least + least // 8, "right"))
        at = small[s : min(same, s + max(1, min(512, STACK // least)))]
        s += len(at)
        place = np.arange(sizes[at[-1]])
        real = place < sizes[at][:, None]
        token = np.minimum(cuts[at][:, None] + place, len(order) - 1)
        mine = np.take(q1, token, axis=0)
        mine[~real] = 0
        cell = starts[at][:, None] + np.arange(GROUP)
        beyond = cell >= ends[at][:, None]
        cell[beyond] = model.none
        rows = model.x[cell, DIM:]
        rows[beyond] = 0
        rows[beyond, DIM] = -1e30
        z = np.matmul(mine, rows.transpose(0, 2, 1))
        flat = z.reshape(-1, GROUP)
        chosen = np.arange(len(flat)), np.where(real, pick[token], 0).ravel()
        total, value = _softmax(flat, flat[chosen], 1)
        real, token = real.ravel(), token.ravel()
        won[token[real]] = value[real]
        if gains is not None:
            flat /= -total
            flat[chosen] += 1
            slope[token[real]] = np.matmul(z, rows[:, :, :DIM]).reshape(-1, DIM)[real]
            grad = np.matmul(z.transpose(0, 2, 1), mine)
            squares = gains.squares[cell, DIM:] + grad * grad
            gains.squares[cell, DIM:] = squares
            grad *= RATE
            grad /= np.sqrt(squares, out=squares)
            grad += rows
            model.x[cell, DIM:] = grad
            gains.moved[cell, 1] += sizes[at][:, None]
            model.x[model.none], gains.moved[model.none] = 0, 0
    for k in np.flatnonzero(~few):
        i, j, a, b = cuts[k], cuts[k + 1], starts[k], ends[k]
        rows = model.x[a:b, DIM:]
        z = q1[i:j] @ rows.T
        cell = np.arange(j - i), pick[i:j]
        total, won[i:j] = _softmax(z, z[cell], 1)
        if gains is not None:
            z /= -total
            z[cell] += 1
            np.matmul(z, rows[:, :DIM], out=slope[i:j])
            grad = z.T @ q1[i:j]
            squares = gains.squares[a:b, DIM:]
            squares += grad * grad
            grad *= RATE
            grad /= np.sqrt(squares)
            rows += grad
            gains.moved[a:b, 1] += j - i
    lp[tokens] += won
    if gains is not None:
        dq[tokens] += slope


def lower(model: Model, vocab: Vocabulary, q, target, own, gains: Gains | None = None):
    """Log-probabilities of all tokens' groups and words given their classes; with ``gains`` the gradient of ``q``."""
    lp, dq = np.zeros(len(target)), None if gains is None else np.zeros_like(q)
    tail = np.flatnonzero(target > END)
    kind, word = target[tail] - END - 1, own[tail]
    known = np.flatnonzero(word < model.words)
    group = vocab.first_group[kind + 1] - 1
    group[known] = vocab.group[word[known]]
    _choose(model, q, tail, kind, model.words + vocab.first_group, model.words + group, gains, lp, dq)
    _choose(model, q, tail[known], group[known], vocab.first_word, word[known], gains, lp, dq)
    return lp, dq


def learn(model: Model, vocab: Vocabulary, ctx, target, own, since, squares: np.ndarray, gains: Gains, rng) -> None:
    """One pass over the tokens, in place: classes, groups and words, then the words of the contexts."""
    parts = -(-len(target) // CHUNK)
    for p in range(parts):
        s, e = len(target) * p // parts, len(target) * (p + 1) // parts
        a = max(0, s - CONTEXT)  # words before the part are read too
        c, t, o = ctx[s:e], target[s:e], own[a:e]
        extra = model.inputs(o, since[a:e])[s - a :]
        q, dq = descend(model, c, t, squares, rng, extra)
        dq += lower(model, vocab, q, t, own[s:e], gains)[1]
        place, turn = model.x[model.positions : model.none, :DIM], np.zeros((CONTEXT, DIM), np.float32)
        grad, times = np.zeros((e - a, DIM), np.float32), np.zeros(e - a, np.int64)
        for b in range(s, e, BATCH):
            f, z = max(a, b - CONTEXT), min(b + BATCH, e)
            each = model.x[own[f:z], :DIM]
            for i in range(CONTEXT):
                k = max(b, i + 1)
                read, past = dq[k - s : z - s].copy(), slice(k - i - 1 - a, z - i - 1 - a)
                apart = since[k:z] <= i
                read[apart] = 0
                turn[i] += np.einsum("nd,nd->d", read, each[k - i - 1 - f : z - i - 1 - f])
                read *= place[i]
                grad[past] += read
                times[past] += ~apart
        known = np.flatnonzero(o < model.words)
        if not len(known):
            continue
        order = known[np.argsort(o[known], kind="stable")]
        head = np.flatnonzero(np.diff(o[order], prepend=-1))
        ids = o[order[head]]
        for where, g in ((ids, np.add.reduceat(grad[order], head)), (np.arange(model.positions, model.none), turn)):
            sq = gains.squares[where, :DIM] + g * g
            gains.squares[where, :DIM] = sq
            model.x[where, :DIM] += RATE * g / np.sqrt(sq)
        gains.moved[ids, 0] += np.add.reduceat(times[order], head)
        gains.moved[model.positions : model.none, 0] += len(t)


WEIGHTS = "block int, ids binary, moved binary, w binary"


def _packed(rows: np.ndarray, moved: np.ndarray, sign: int):
    """The rows that moved, by blocks; those of classes have negative numbers."""
    ids = np.flatnonzero(moved.any(1)).astype(np.int32)
    for at in np.split(ids, np.flatnonzero(np.diff(ids // BLOCK)) + 1) if len(ids) else ():
        n = int(at[0]) // BLOCK
        yield n if sign > 0 else -1 - n, at.tobytes(), moved[at].tobytes(), rows[at].tobytes()


def _train(batches, vocab: Vocabulary):
    model, n = Model(vocab), 0
    squares, gains = np.zeros_like(model.w), Gains(model)
    rng = np.random.Generator(np.random.PCG64(7))
    for b in slices(batches, "text"):
        w = words(b.column("text"))
        _, cls, word = vocab.classes(w)
        ctx, target, own, since = _stream(w, cls, np.where(word < model.words, word, model.none), model.none)
        learn(model, vocab, ctx, target, own, since, squares, gains, rng)
        n += len(target)
    if n:
        rows = [*_packed(model.w, np.full((Model.ROWS, 2), n, np.float32), -1), *_packed(model.x, gains.moved, 1)]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["block", "ids", "moved", "w"])


def _average(frame):
    block = int(frame["block"].iloc[0])
    width = DIM + 1 if block < 0 else 2 * DIM + 1
    ids = np.frombuffer(b"".join(frame["ids"]), np.int32)
    moved = np.frombuffer(b"".join(frame["moved"]), np.float32).reshape(-1, 2).astype(float)
    rows = np.frombuffer(b"".join(frame["w"]), np.float32).reshape(-1, width)
    value, back = np.unique(ids, return_inverse=True)
    total, out = np.zeros((len(value), 2)), np.zeros((len(value), width))
    np.add.at(total, back, moved)
    np.add.at(out[:, :DIM], back, rows[:, :DIM] * moved[:, :1])
    np.add.at(out[:, DIM:], back, rows[:, DIM:] * moved[:, 1:])
    out[:, :DIM] /= np.maximum(total[:, :1], 1)
    out[:, DIM:] /= np.maximum(total[:, 1:], 1)
    frame = frame.iloc[:1].copy()
    for name, x in (("ids", value.astype(np.int32)), ("moved", total.astype(np.float32)), ("w", out.astype(np.float32))):
        frame[name] = [x.tobytes()]
    return frame


def train_model(docs: DataFrame, vocab) -> tuple[np.ndarray, np.ndarray]:
    """The averaged tables: of classes, the same size whatever the corpus, and of words. ``vocab`` is a broadcast variable."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(lambda b: _train(b, vocab.value), WEIGHTS).groupBy("block").applyInPandas(_average, WEIGHTS).collect()
    model = Model(vocab.value)
    for r in rows:
        table = model.w if r["block"] < 0 else model.x
        ids = np.frombuffer(r["ids"], np.int32)
        moved = np.frombuffer(r["moved"], np.float32).reshape(-1, 2) > 0
        w = np.frombuffer(r["w"], np.float32).reshape(len(ids), -1)
        table[ids, :DIM] = np.where(moved[:, :1], w[:, :DIM], table[ids, :DIM])
        table[ids, DIM:] = np.where(moved[:, 1:], w[:, DIM:], table[ids, DIM:])
    return model.w, model.x


SCORED = "_row long, doc_id {}, held_out boolean, n_tokens long, known long, base double, score double, rest array<long>, times array<long>"


def _score(batches, vocab: Vocabulary, weights: tuple[np.ndarray, np.ndarray]):
    model = Model(vocab)
    model.w, model.x = weights
    vectors, bias = np.ascontiguousarray(model.out[:, :DIM]), model.out[:, DIM:].copy()
    unit = np.log10(vocab.total + vocab.kinds + 1)
    for b in slices(batches, "text"):
        w = words(b.column("text"))
        slot, cls, word = vocab.classes(w)
        hit = slot >= 0
        docs = b.num_rows
        doc = np.repeat(np.arange(docs), np.diff(w.first))
        ctx, target, own, since = _stream(w, cls, np.where(word < model.words, word, model.none), model.none)
        q = model.predict(ctx) + model.inputs(own, since)
        lp = np.empty(len(target))
        for s in range(0, len(target), WIDE):  # a class a row: sums run over tokens side by side
            z = vectors @ q[s : s + WIDE].T
            z += bias
            lp[s : s + WIDE] = _softmax(z, z[target[s : s + WIDE], np.arange(z.shape[1])], 0)[1]
        lp += lower(model, vocab, q, target, own)[0]
        whose = np.repeat(np.arange(docs), np.diff(w.first) + 1)
        n = np.diff(w.first) + 1
        score = np.bincount(whose, lp / np.log(10), docs)
        score -= np.bincount(doc[~hit], np.log10(vocab.rest)[cls[~hit] - END - 1], docs)
        base = np.bincount(doc[hit], vocab.count[slot[hit]], docs) + np.log10(vocab.end_count + 1) - n * unit
        known = np.bincount(doc[hit], minlength=docs) + (vocab.end_count > 0)
        d, h = doc[~hit], w.hash[~hit]
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        head = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]))) if len(d) else np.zeros(0, np.int64)
        times = np.diff(np.append(head, len(d)))
        at = np.searchsorted(d[head], np.arange(docs + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(at, x) for x in (h[head].view(np.int64), times.astype(np.int64))]
        cols = [b.column("_row"), b.column("doc_id"), b.column("held_out"), *map(pa.array, (n, known.astype(np.int64), base, score)), *lists]
        yield pa.RecordBatch.from_arrays(cols, ["_row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rest", "times"])


def score_documents(docs: DataFrame, held_out) -> DataFrame:
    """Train on the documents where ``held_out`` is false, then score all of them.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``;
    scores are sums of log10 probabilities over a text's tokens.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text")
    )
    learn = rows.where("not held_out")
    counts = cut_lineage(count_words(learn))
    vocab = spark.sparkContext.broadcast(build_vocabulary(counts))
    weights = spark.sparkContext.broadcast(train_model(learn, vocab))
    scored = cut_lineage(rows.mapInArrow(
        lambda b: _score(b, vocab.value, weights.value), SCORED.format(dict(rows.dtypes)["doc_id"])
    ))
    rest = scored.select("_row", F.inline(F.arrays_zip(F.col("rest").alias("h"), F.col("times").alias("times"))))
    rest = rest.join(counts.select("h", "c"), "h").groupBy("_row").agg(
        F.sum(F.log10(F.col("c") + 1) * F.col("times")).alias("more"), F.sum("times").alias("seen")
    )
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return scored.drop("rest", "times").join(rest, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + seen).alias("n_known"),
        F.lit(vocab.value.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def score_by_id(docs: DataFrame, mod: int = 7, out: int = 2) -> DataFrame:
    """``score_documents`` with the rows held out by a checksum of their ids."""
    return score_documents(docs, remainder("doc_id", mod) == out)

