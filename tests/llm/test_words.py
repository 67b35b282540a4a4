import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from parley.llm.tokens import TokenTable
from parley.llm.words import shingles, slices, words

TEXTS = ["The cat sat  on\tthe mat\n", "", None, "a", " x y ", "ÉTÉ Ünï co de", "one two three four five six"] * 3


def _brute(text):
    return [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0d]+", text or "")]


def test_words_have_their_places_and_equal_hashes_only_for_equal_words():
    w = words(pa.array(TEXTS))
    seen = {}
    for i, t in enumerate(TEXTS):
        at = range(w.first[i], w.first[i + 1])
        own = [bytes(w.data[w.start[j] : w.end[j]]).decode() for j in at]
        assert own == _brute(t)
        for j, x in zip(at, own):
            assert seen.setdefault(x, w.hash[j]) == w.hash[j]
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("k", [1, 2, 4])
def test_shingles_match_tuples(k):
    w = words(pa.array(TEXTS))
    h, begin = shingles(w.hash, w.first, k)
    names = {}
    for i, t in enumerate(TEXTS):
        ws = _brute(t)
        want = [tuple(ws[j : j + k]) for j in range(max(1, len(ws) - k + 1))] if ws else []
        got = h[begin[i] : begin[i + 1]]
        assert len(got) == len(want)
        for x, g in zip(want, got):
            assert names.setdefault(x, g) == g
    assert len(set(names.values())) == len(names)


def test_hashes_do_not_depend_on_slices():
    text = pa.array([" ".join(f"w{i * j}" for j in range(300)) for i in range(50)])
    whole = words(text).hash
    parts = [words(b.column(0)).hash for b in slices([pa.RecordBatch.from_arrays([text], ["t"])], "t", 1000)]
    assert len(parts) > 10 and np.array_equal(np.concatenate(parts), whole)


def test_ids_are_the_tokenizers_own():
    texts = TEXTS + [
        "don't we'll I'M it’s 3.14 (a-b) x²½ ١٢ ﬁ ǅ", "<|endoftext|> <|ENDOFTEXT|> a<b", "Straße ÀÉÎ Ÿ×÷µ á ́b",
        "日本語 текст x\x1cy\x00z", "!!'s ''s", "a" * 5000,
    ]
    table = TokenTable(public_tokenizers.path("word_bpe_49k.json"))
    want = [e.ids + [1] for e in table.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # from the tokenizer, then from the table
        ids, at = table.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
