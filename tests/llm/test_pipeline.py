import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from parley.llm import mixing, quality_model, secret_scan
from parley.session import cut_lineage

from .test_secret_scan import _base
from .test_trie_join import _components, _set


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], sf_dir)))
    return out


def _rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns_of_documents(steps):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "best-fit packing"]
    assert all(s.schema.simpleString() == steps[0].schema.simpleString() for s in steps[:-1])


def test_rejected_documents_go_and_good_ones_stay(spark, sf_dir, steps):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = quality_model.score_documents(steps[0], labels)
    want = {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    assert set(_rows(steps[1])) == want
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good & want) > 0.97 * len(good) and len(bad & want) < 0.2 * len(bad)


def test_one_of_each_class_stays(steps):
    rows = sorted(steps[1].collect(), key=lambda r: r["doc_id"])
    top = _components([_set(r["text"], 5) for r in rows], 4, 5)
    assert set(_rows(steps[2])) == {r["doc_id"] for i, r in enumerate(rows) if top[i] == i}


def test_secrets_are_gone_and_nothing_else(steps):
    before, after = _rows(steps[2]), _rows(steps[3])
    assert set(before) == set(after)
    found = {r["doc_id"] for r in secret_scan.scan(steps[2]).where("spans != ''").collect()}
    for i, r in after.items():
        assert not _base(r["text"]) and r["n_chars"] == len(r["text"])
        assert (r["text"] != before[i]["text"]) == (i in found)


def test_mixture_is_taken(steps):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_documents(steps[3]).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in steps[4].collect()) == Counter(want)
    words = sum(len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or "")) for r in steps[3].collect())
    mixed = sum(len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or "")) for r in steps[4].collect())
    assert abs(mixed / words - 1) < 0.2


def test_everything_is_packed(steps):
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in steps[4].collect():
        want[r["doc_id"]] += len(coder.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in steps[5].collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_stages_bear_nulls_repeats_and_no_rows(spark, sf_dir, messy, nothing):
    for docs in (messy.select(*cp.COLUMNS), nothing):
        for _, stage in cp.STAGES:
            docs = cut_lineage(stage(spark, docs, sf_dir))
    assert docs.count() == 0
    twice = messy.select(*cp.COLUMNS).where("doc_id = 1")
    kept = cp.keep_one_of_each(spark, twice, sf_dir).collect()
    assert sorted(r["text"] for r in kept) == ["another text under the same id", "the quick brown fox jumps over the lazy dog"]
