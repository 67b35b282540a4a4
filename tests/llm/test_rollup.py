from collections import Counter

from parley.llm.rollup import Rollup
from parley.session import scratch_path

EVENTS = "action string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def _totals(store):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in store.totals().collect()}


def _brute(events):
    docs, tokens = Counter(), Counter()
    for a, s, g, v, new, old in events:
        k, new, old = (s, g, v), new or 0, old or 0
        docs[k] += {"insert": 1, "delete": -1}.get(a, 0)
        tokens[k] += {"insert": new, "delete": -new, "revise": new - old}.get(a, 0)
    return {k: (docs[k], tokens[k]) for k in docs}


def test_signed_events_and_repeated_commits(spark):
    first = [("insert", f"s{i % 3}", "en", "v1", i, None) for i in range(50)] + [("insert", None, None, None, None, None)]
    second = [("delete", "s0", "en", "v1", 3, None), ("revise", "s1", "en", "v1", 9, 4), ("other", "s2", "en", "v1", 7, 1), (None, "s2", "fr", "v1", 5, 5)]
    store = Rollup(spark, scratch_path(spark, "rollup"))
    assert store.totals().count() == 0
    one, two = (spark.createDataFrame(x, EVENTS) for x in (first, second))
    assert store.commit("b1", one) and not store.commit("b1", one)
    assert store.commit("b2", two) and not store.commit("b2", one)
    assert _totals(store) == _brute(first + second)
    assert _totals(Rollup(spark, store.path)) == _totals(store)  # nothing is held in memory


def test_unfinished_batch_is_written_again(spark):
    store = Rollup(spark, scratch_path(spark, "rollup"))
    events = [("insert", "a", "en", "v1", 5, None)]
    frame = spark.createDataFrame(events, EVENTS)
    store.commit("b1", frame)
    fs, p = store._fs(f"{store.path}/b1/_SUCCESS")
    fs.delete(p, False)
    assert store.totals().count() == 0
    assert store.commit("b1", frame)
    assert _totals(store) == _brute(events)


def test_compaction_and_empty_batches(spark):
    store = Rollup(spark, scratch_path(spark, "rollup"))
    events = [("insert", "a", "en", "v1", 5, None)] * 4
    store.commit("b1", spark.createDataFrame(events, EVENTS))
    store.commit("none", spark.createDataFrame([], EVENTS))
    small = store.compact(scratch_path(spark, "rollup"))
    assert _totals(small) == _totals(store) == _brute(events)
    small.commit("b2", spark.createDataFrame([("delete", "a", "en", "v1", 5, None)], EVENTS))
    assert _totals(small) == {("a", "en", "v1"): (3, 15)}


def test_a_batch_sent_again_after_compactions_counts_once(spark):
    store = Rollup(spark, scratch_path(spark, "rollup"))
    first = spark.createDataFrame([("insert", "a", "en", "v1", 5, None)], EVENTS)
    second = spark.createDataFrame([("insert", "a", "en", "v1", 7, None)], EVENTS)
    store.commit("b1", first)
    store = store.compact(scratch_path(spark, "rollup"))
    assert not store.commit("b1", first) and store.commit("b2", second)
    store = store.compact(scratch_path(spark, "rollup"))
    assert not store.commit("b1", first) and not store.commit("b2", second)
    assert _totals(store) == {("a", "en", "v1"): (2, 12)}


def test_insert_and_delete_of_everything_leaves_zeros(spark):
    store = Rollup(spark, scratch_path(spark, "rollup"))
    rows = [(f"s{i % 2}", "en", "v1", i) for i in range(20)]
    for action in ("insert", "delete"):
        store.commit(action, spark.createDataFrame([(action, *r, None) for r in rows], EVENTS))
    assert set(_totals(store).values()) == {(0, 0)}
