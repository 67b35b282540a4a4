import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parley.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def _check(docs, rows, capacity=4096):
    coder = Tokenizer.from_file(PATH)
    want = []
    for r in docs:
        ids = coder.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[s : s + capacity], "<u4")
            want.append((str(r["doc_id"]), p, s, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(w[3] for w in want)


@pytest.mark.parametrize("parts", [1, 5])
def test_pieces_and_places(spark, sf_dir, parts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(parts)
    n, tokens = _check(docs.collect(), packing.pack(docs, PATH).collect())
    assert n <= 1.06 * tokens / 4096 + 1


def test_second_pass_in_groups(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    _check(docs.collect(), packing.pack(docs, PATH, capacity=512, open_bins=4, group_pieces=50).collect(), 512)


def test_best_fit_takes_the_tightest_place_and_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert not fit.used and fit.mask == 0
    assert [fit.put(n) for n in (8, 7, 9)] == [(2, 0), (3, 0), (4, 0)]
    assert fit.closed[-1] == 2 and set(fit.used) == {3, 4}


def test_no_open_sequence_that_fits_is_passed_over():
    rng = np.random.default_rng(3)
    fit, free = packing.BestFit(100, 8), {}
    for n in rng.integers(1, 101, 5000).tolist():
        fitting = [f for f in free.values() if f >= n]
        b, at = fit.put(n)
        if fitting:
            assert free[b] == min(fitting)
        else:
            assert at == 0
            closed = set(free) - set(fit.used)
            assert [free[x] for x in closed] == ([min(free.values())] if len(free) == 8 else [])
        free = {x: 100 - u for x, u in fit.used.items()}


def test_edges(messy, nothing):
    _check(messy.collect(), packing.pack(messy, PATH).collect())
    assert packing.pack(nothing, PATH).count() == 0
