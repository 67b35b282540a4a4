"""Spelling variants of a vocabulary through an index of variable-length grams.

1. The words of all texts are counted; a word is a distinct one with its count.
2. A word is written between two marks. A gram is heavy when more than ``MANY``
   places of the vocabulary begin with it, or more than one in ``SHARE``. The gram
   dictionary grows by length: only heavy grams are extended, so that a place of a
   word has one gram, the shortest that is not heavy. Heavy grams are at most
   ``SHARE`` a length, ``LONGEST`` lengths; they are all that is sent to the tasks.
3. One edit affects the grams that cover its place. The number of a word's grams that
   a single edit can affect is its bound; a near word holds one of any larger number
   of its grams. The bound is below their number exactly when two grams are
   disjoint; these two then have the bound one, and only their two lists are merged.
4. Words without two disjoint grams (short or made of heavy grams), and those of more
   than ``LONG`` letters, whose lists would repeat them too often, are found by their
   halves: an edit leaves one half as it is, at its end of the word.
5. A list holds the words that have a gram at one place and have one length. A word is
   looked up in the lists of its own length and of one more, at its gram's place
   and, for longer words, at the next. Candidates differ in one edit at most when
   their edit distance says so.

Each word has at most some 120 near words a place, so sums by word stay small.
The list of a half that very many words of one length share is compared whole;
the join splits it over tasks.

Defined cases: a null text has no words, a null id is an empty one; a place of
deletion is counted in code points; repeated rows count each; letters beyond the
pattern's end words; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_of
from .words import mix

WORD = r"[A-Za-zÀ-ÿ]{%d,}"
LETTERS = 5
TIMES = 3
SHORTEST, LONGEST = 2, 7  # letters of a gram, the marks included
MANY = 100
SHARE = 1 << 20
LONG = 64  # letters of a word, the marks included, that is found by its grams
PIECE = 20_000  # words taken together in a task


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z, all other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(docs: DataFrame, slip: int | None = 97, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """``word, n``: words of at least ``letters`` letters that occur ``times`` times.

    Where ``slip`` divides the checksum of ``<doc_id>:<word>``, the letter that the
    checksum points at is left out. Occurrences are summed in the tasks first.
    """
    found = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text_of(), F.lit(WORD % letters), F.lit(0))).alias("w")
    ).select("d", lower_ascii(F.col("w")).alias("w"))
    if slip:
        h = F.crc32(F.concat("d", F.lit(":"), "w").cast("binary"))
        at = F.pmod(F.col("h"), F.length("w")).cast("int")
        less = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
        found = found.withColumn("h", h).select(F.when(F.col("h") % slip == 0, less).otherwise(F.col("w")).alias("w"))
    counted = found.where(F.length("w") >= letters).groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= times)


class Letters:
    """Words of a batch as one row of bytes, each between two marks."""

    def __init__(self, words: pa.Array):
        codes = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words.to_pylist()]
        # letters of other alphabets share bytes; the words themselves are compared in the end
        flat = np.concatenate([np.array([0], np.uint32), *codes]) if codes else np.zeros(1, np.uint32)
        flat = np.where(flat < 256, flat, 128 + flat % 127).astype(np.uint64)[1:]
        self.size = np.array([len(c) for c in codes], np.int64) + 2
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.full(self.first[-1], 1, np.uint64)  # the mark
        inner = np.ones(self.first[-1], bool)
        inner[self.first[:-1]] = False
        inner[self.first[1:] - 1] = False
        self.data[inner] = flat
        self.word = np.repeat(np.arange(len(codes)), self.size)
        self.left = self.first[1:][self.word] - np.arange(len(self.data))  # letters from here to the end

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, grams of ``size`` letters that begin there)."""
        at = np.flatnonzero(self.left >= size)
        out = np.zeros(len(at), np.uint64)
        for i in range(size):
            out |= self.data[at + i] << np.uint64(8 * i)
        return at, out


def _alive(letters: Letters, heavy: list[np.ndarray]) -> np.ndarray:
    """Places whose grams of all lengths so far are heavy."""
    live = np.ones(len(letters.data), bool)
    for size, known in enumerate(heavy, SHORTEST):
        at, g = letters.grams(size)
        fits = np.zeros(len(live), bool)
        fits[at] = np.isin(g, known)
        live &= fits
    return live


def _count_grams(batches, size: int, heavy: list[np.ndarray]):
    for batch in batches:
        letters = Letters(batch.column("word"))
        live = _alive(letters, heavy)
        at, g = letters.grams(size)
        g, c = np.unique(g[live[at]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c)], ["g", "c"])


def heavy_grams(words: DataFrame, many: int = MANY) -> list[np.ndarray]:
    """The gram dictionary's inner part: heavy grams by length, at most ``SHARE`` of each."""
    heavy: list[np.ndarray] = []
    for size in range(SHORTEST, LONGEST + 1):
        counts = words.select("word").mapInArrow(lambda b, s=size, h=list(heavy): _count_grams(b, s, h), "g long, c long")
        counts = cut_lineage(counts.groupBy("g").agg(F.sum("c").alias("c")).where(F.col("c") > many))
        places = counts.agg(F.sum("c")).first()[0] or 0
        rows = counts.where(F.col("c") > places // SHARE).select("g").toPandas()  # fewer than SHARE rows
        heavy.append(np.sort(rows["g"].to_numpy(np.int64).view(np.uint64)))
    return heavy


def variable_grams(letters: Letters, heavy: list[np.ndarray]) -> np.ndarray:
    """Length of the gram at every place: the shortest that is not heavy, 0 where the word ends before or none is."""
    size_at = np.zeros(len(letters.data), np.int64)
    live = np.ones(len(letters.data), bool)
    for size, known in enumerate(heavy, SHORTEST):
        live &= letters.left >= size
        at, g = letters.grams(size)
        fits = np.zeros(len(live), bool)
        fits[at] = np.isin(g, known)
        size_at[live & ~fits] = size
        live &= fits
    return size_at


def disjoint_pair(letters: Letters, size_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a word has two disjoint grams, place of the first to end, place of the last to begin)."""
    n = len(letters.data)
    place = np.arange(n)
    end = np.where(size_at > 0, place + size_at, n + LONGEST)
    words = np.arange(len(letters.size))
    if not len(words):
        return np.zeros(0, bool), words, words
    order = np.lexsort((place, end, letters.word))
    first = order[letters.first[:-1]]
    last = np.maximum.reduceat(np.where(size_at > 0, place, -1), letters.first[:-1])
    return (last >= 0) & (end[first] <= last), first, last


ENTRIES = "key long, ask boolean, word string, n long"


def _entries(batches, heavy: list[np.ndarray]):
    """List entries of every word (``ask`` false) and the lists in which it looks for near words of its length or one more."""
    for whole in batches:
        for s in range(0, whole.num_rows, PIECE):
            batch = whole.slice(s, PIECE)
            letters = Letters(batch.column("word"))
            size_at = variable_grams(letters, heavy)
            fine, first, last = disjoint_pair(letters, size_at)
            fine &= letters.size <= LONG
            keys, who, asks = [], [], []

            def add(key, word, ask, keys=keys, who=who, asks=asks):
                keys.append(key)
                who.append(word)
                asks.append(np.full(len(word), ask))

            def gram_keys(at, shift, size, letters=letters, size_at=size_at):
                """Key of the gram at ``at`` as found ``shift`` places on in a word of ``size`` letters."""
                g = np.zeros(len(at), np.uint64)
                for i in range(LONGEST):
                    more = np.flatnonzero(size_at[at] > i)
                    g[more] |= letters.data[at[more] + i] << np.uint64(8 * i)
                since = at - letters.first[:-1][letters.word[at]] + shift
                return mix(mix(g) + (since * 2654435761 + size * 40503).astype(np.uint64))

            def piece_keys(word, from_, to, side, size, letters=letters):
                """Key of the letters from one place to another of a word, at an end of words of ``size`` letters."""
                width = to - from_
                ends = np.cumsum(width)
                since = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - width, width)
                codes = letters.data[np.repeat(letters.first[:-1][word] + from_, width) + since]
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(codes + (since * 131).astype(np.uint64)), dtype=np.uint64)])
                return mix(sums[ends] - sums[ends - width] + (size * 4 + side + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

            everyone = np.arange(len(letters.size))
            at = np.flatnonzero((size_at > 0) & (letters.size <= LONG + 1)[letters.word])
            add(gram_keys(at, 0, letters.size[letters.word[at]]), letters.word[at], False)
            for shorter in (0, 1):  # as the partner of a word of that many letters less
                size = letters.size - shorter
                half = size // 2
                add(piece_keys(everyone, 0 * half, half, 0, size), everyone, False)
                add(piece_keys(everyone, half + shorter, letters.size, 1, size), everyone, False)
            pair = np.flatnonzero(fine)
            for at in (first[pair], last[pair]):
                for shift, more in ((0, 0), (0, 1), (1, 1)):
                    add(gram_keys(at, shift, letters.size[pair] + more), pair, True)
            rest = np.flatnonzero(~fine)
            size, half = letters.size[rest], letters.size[rest] // 2
            add(piece_keys(rest, 0 * half, half, 0, size), rest, True)
            add(piece_keys(rest, half, size, 1, size), rest, True)
            who = np.concatenate(who)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(asks)),
                    batch.column("word").take(pa.array(who)), batch.column("n").take(pa.array(who)),
                ],
                ["key", "ask", "word", "n"],
            )


def one_edit(a: Column, b: Column) -> Column:
    """Whether one edit makes ``b``, as long as ``a`` or one letter longer, of another word ``a``; one pass for long words."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, False).cast("int")  # 0: b only goes on
    at = F.when(differs > 0, differs).otherwise(F.length(b))
    longer = F.length(b) - F.length(a)
    rest = F.substring(a, at + 1 - longer, F.length(a)) == F.substring(b, at + 1, F.length(b))
    return F.when(F.length(a) <= LONG, F.levenshtein(a, b, 1) == 1).otherwise(rest)


def near_pairs(words: DataFrame, heavy: list[np.ndarray]) -> DataFrame:
    """``a, na, b, nb``: each pair of ``word, n`` at edit distance one, once."""
    sent = words.sparkSession.sparkContext.broadcast(heavy)
    entries = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(lambda b: _entries(b, sent.value), ENTRIES))
    ask = entries.where("ask").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    held = entries.where("not ask").select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
    longer = F.length("b") - F.length("a")
    once = (longer == 1) | ((longer == 0) & (F.col("a") < F.col("b")))
    pairs = ask.join(held, "key").where(once & one_edit(F.col("a"), F.col("b")))
    return pairs.groupBy("a", "b").agg(F.min("na").alias("na"), F.min("nb").alias("nb"))


def group_variants(words: DataFrame, ratio: int = 2, many: int = MANY) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the words of ``word, n``.

    The form is the near word that occurs most often (ties: the smallest), if it
    occurs ``ratio`` times as often as the word or more. Counts at least double
    from form to form, so that a chain has few steps; roots are found by doubling.
    """
    words = cut_lineage(words)
    pairs = near_pairs(words, heavy_grams(words, many))
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("c")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("c")),
    )).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("c")).alias("c"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    good = -F.col("best.c") >= ratio * F.col("n")
    rows = cut_lineage(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.c")).cast("long").alias("form_n"),
    ))
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = cut_lineage(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = steps.select("word", "root")
        if not steps.where("moved").limit(1).count():
            break
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
