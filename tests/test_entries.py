import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import chat, col, entries, json_of, pairs, records
from parley.functions import text as tx
from parley.functions.constants import IMPORT_SYSTEM_PROMPT
from parley.operators import entries as en
from parley.operators import features as fe
from parley.operators import formats as fo
from parley.operators import normalize as no
from parley.operators import quality as qu
from parley.operators import search as se
from parley.operators.ordering import dense_index, running_total
from parley.sources import files


def test_json_survives_the_round_trip(spark):
    items = [
        {"messages": [{"role": "user", "content": "ü \"q\" \n", "name": "N"}, 5, {"role": 7}, {"content": None}], "tags": ["a", 1, None], "x": {"b": [1, 2]}},
        {"messages": "no", "tags": {"a": 1}},
        {"other": None},
        chat("Hi", "Yo", tags=["t"]),
    ]
    assert json_of(entries(spark, items)) == items


def test_features_agree_on_both_routes(spark):
    items = [chat("One two", "todo", "x", "a longer answer here"), chat("Hi", "", system=None), chat(system="  ")]
    nested = entries(spark, items)
    a = fe.from_entries(nested).select(*fe.FEATURES).orderBy("entry_index").collect()
    b = fe.from_turns(en.entries_to_turns(nested)).select(*fe.FEATURES).orderBy("entry_index").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_placeholders(spark):
    words = ["todo", "This is a test", "word", "n/a", "A full answer.", "", "Contest winner"]
    df = spark.createDataFrame([(w,) for w in words], "c string")
    got = [r[0] for r in df.select(fe.is_placeholder(F.col("c"), tx.word_count(F.col("c")))).collect()]
    assert got == [True, True, True, True, False, False, True]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \t\n 　aZé'_9.-ß", max_size=12), min_size=1, max_size=20))
def test_text_functions_equal_python(spark, texts):
    import re

    df = spark.createDataFrame(list(enumerate(texts)), "i long, c string")
    rows = df.select(
        "i", tx.strip(F.col("c")), tx.word_count(F.col("c")), tx.search_form(F.col("c")), tx.slug(F.col("c"))
    ).orderBy("i").collect()
    for text, r in zip(texts, rows):
        assert r[1] == text.strip()
        assert r[2] == len(re.findall(r"\b[\w']+\b", text))
        assert r[3] == " ".join(text.casefold().split())
        assert r[4] == re.sub(r"[^a-z0-9]+", "_", text.strip().lower()).strip("_")


def test_slug_and_display_name(spark):
    df = spark.createDataFrame([("  Q&A / AI  Tips ",), ("héllo",), ("__",)], "t string")
    rows = df.select(tx.slug(F.col("t")).alias("s")).select("s", no.tag_display_name(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("q_a_ai_tips", "Q A AI Tips"), ("h_llo", "H Llo"), ("", "")]


def test_baseline_counters_and_idempotence(spark):
    item = {
        "messages": [{"role": "SYSTEM", "content": " s"}, {"role": "gpt", "content": "u"}, {"role": "bot", "content": "a"}],
        "tags": [" a", "a", "", 3, "b ", " b "],
    }
    once = no.normalize_baseline(entries(spark, [item]))
    r = once.first()
    # only spellings of the role that is due are changed: gpt stays at the user's place
    assert [(m["role"], m["content"]) for m in r["messages"]] == [("system", "s"), ("gpt", "u"), ("assistant", "a")]
    assert r["tags"] == ["a", "b"]
    assert (r["roles_normalized"], r["contents_trimmed"], r["tags_changed"]) == (2, 1, 6)
    assert r["dropped_tags"] == ["", "3"]
    again = no.normalize_baseline(once.select(*en.ENTRY_COLUMNS)).first()
    assert not again["changed"] and again["tags_changed"] == 0


def test_slug_tag_counters(spark):
    item = {**chat("a", "b"), "tags": ["Red Hat", "red_hat", "x", "??", "RED-HAT"]}
    r = no.normalize_tags(entries(spark, [item])).first()
    assert r["tags"] == ["red_hat", "x"]
    assert (r["slug_changed_tags"], r["slug_dropped"], r["slug_changed"]) == (4, 1, True)


def test_scaffold(spark):
    def run(*messages):
        items = [{"messages": [m if not isinstance(m, tuple) else {"role": m[0], "content": m[1]} for m in messages], "tags": []}]
        out = entries(spark, items).withColumn("messages", no.scaffold_turns(F.col("messages")))
        return pairs(out)[0]

    assert run(("system", "s"), ("gpt", "a")) == [("system", "s"), ("user", ""), ("assistant", "a")]
    assert run(("user", "u")) == [("user", "u"), ("assistant", "")]
    assert run(("user", "u"), ("user", "v")) == [("user", "u"), ("assistant", ""), ("user", "v"), ("assistant", "")]
    assert run(("user", "u"), ("Emma", "e")) == [("user", "u"), ("Emma", "e")]
    assert run(("user", "u"), ("system", "s"), ("user", "v")) == [
        ("user", "u"), ("assistant", ""), ("system", "s"), ("user", "v"), ("assistant", "")
    ]


def test_formats_vote_and_tie(spark):
    c, s = chat("a", "b"), {"conversations": []}
    both = {"messages": [], "conversations": []}
    fmt = lambda items: tuple(fo.detect_dataset_format(records(spark, items)).select("format", "confidence").first())
    assert fmt([c, c, s]) == ("chatml", 2 / 3)
    assert fmt([c, s]) == ("unknown", 0.5)
    assert fmt([both, {"x": 1}, "3"]) == ("unknown", 1.0)


def test_sharegpt_conversion(spark):
    items = [
        {"conversations": [{"from": "system", "value": "A"}, {"role": "sys", "content": " "}, {"speaker": "system", "text": "B"}, {"from": "human", "value": "q"}, {"from": "Emma", "value": "e"}], "keep": [1], "tags": ["t"]},
        {"conversations": [{"from": "gpt"}, {"value": "lost"}, 4]},
        {"conversations": [{"from": "system", "value": " "}, {"from": 3, "value": 4}]},
    ]
    out = fo.sharegpt_to_chatml(records(spark, items))
    assert pairs(out) == [
        [("system", "A\n\nB"), ("user", "q"), ("Emma", "e")],
        [("system", IMPORT_SYSTEM_PROMPT), ("assistant", "")],
        [("system", IMPORT_SYSTEM_PROMPT), ("3", "4")],
    ]
    assert [len(w) for w in col(out, "warnings")] == [2, 4, 2]
    assert json_of(out)[0]["keep"] == [1]


def test_sharegpt_round_trip(spark):
    items = [{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "tags": []}]
    back = fo.chatml_to_sharegpt(fo.sharegpt_to_chatml(records(spark, items)).drop("warnings"))
    assert [(t["from"], t["value"]) for t in back.first()["conversations"]] == [("human", "q"), ("gpt", "a")]


def _named(spark, *sequences):
    return fo.custom_role_turns(
        entries(spark, [{"messages": [{"role": r, "content": "x"} for r in s], "tags": []} for s in sequences])
    )


@pytest.mark.parametrize(
    "sequences,want",
    [
        ((["Ann", "Bob"], ["Ann", "Bob", "Ann", "Bob"]), {"Ann": "user", "Bob": "assistant"}),
        ((["Ann", "Bob", "Ann"], ["Bob"]), {"Ann": "user", "Bob": "assistant"}),
        ((["Ann", "Bob"], ["Bob", "Ann"]), {}),
        ((["God", "Ann", "Bob"], ["Ann", "Bob"]), {"God": "system", "Ann": "user", "Bob": "assistant"}),
        ((["Ann", "God", "Bob"], ["Ann"]), {}),
        ((["Ann"],), {}),
        ((["Ann", "Bob", "Cid", "Dan"],), {}),
    ],
)
def test_custom_role_pattern(spark, sequences, want):
    got = fo.custom_role_pattern(_named(spark, *sequences))
    assert {r["label"]: r["role"] for r in got.collect()} == want


def test_tag_filter_rules(spark):
    df = entries(spark, [chat("a", "b", tags=t) for t in (["x"], ["x", "y"], [], ["z"])])
    pick = lambda tags, mode: col(se.filter_tags(df, tags, mode), "entry_index")
    assert pick([], "any") == [0, 1, 2, 3]
    assert pick(["x"], "any") == [0, 1]
    assert pick(["x", "y"], "all") == [1]
    assert pick(["x"], "exact") == [0]
    assert pick(["__untagged__"], "any") == [2]
    assert pick(["x", "__untagged__"], "any") == [0, 1]
    assert pick(["x", "__untagged__"], "exact") == [0, 2]
    with pytest.raises(ValueError):
        se.matches_tags(["x"], "none")


def test_search_modes(spark):
    df = entries(spark, [chat("The  quick\nfox", "STRASSE"), chat("fox quick", "no", system="secret fox place here")])
    pick = lambda *a: col(se.search(df, *a), "entry_index")
    assert pick("quick fox") == [0]
    assert pick("fox quick", "all_words") == [0, 1]
    assert pick("straße") == [0]
    assert pick("secret", "contains", ("system",)) == [1]
    assert pick("   ") == [0, 1]
    assert pick("fox", "contains", ("nobody",)) == []
    with pytest.raises(ValueError):
        se.matches_search("x", "fuzzy")


def test_pages_are_clamped(spark):
    df = spark.range(7).select(F.col("id").alias("entry_index"))
    page = lambda *a, **k: col(se.page(df, *a, **k), "entry_index")
    assert page(0, 3) == [0, 1, 2]
    assert page(9, 3) == [6]
    assert page(-2, 3) == [0, 1, 2]
    assert page(0, 3, show_all=True) == list(range(7))


def test_all_entries_can_be_shown(spark):
    df = spark.range(1500).select(F.col("id").alias("entry_index"))
    assert se.page(df, 0, show_all=True).count() == 1500


def test_repeated_patches_and_unknown_split_ids(spark):
    from parley.operators import mutate as mu

    df = entries(spark, [chat("a", "b", "c", "d"), chat("e", "f")])
    patch = entries(spark, [chat("x", "1"), chat("x", "2")]).withColumn("entry_id", F.lit("entry_index:1"))
    out, rejects = mu.upsert_entries(df, patch)
    assert rejects.count() == 0
    assert [m[2][1] for m in pairs(out)] == ["b", "2"]
    asked = spark.createDataFrame([("entry_index:0", [1]), ("entry_index:0", [1]), ("entry_index:9", [1])], "entry_id string, split_points array<int>")
    parts, rejects, *_ = mu.split_entries(df, asked)
    assert parts.count() == 3
    assert [tuple(r) for r in rejects.collect()] == [("entry_index:9", "no such entry")]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from parley import session

    conf = SimpleNamespace(get=lambda *a: None)
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_positions_do_not_depend_on_partitioning(spark, buckets):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("k")).repartition(13)
    rows = dense_index(df, "k", buckets=buckets).orderBy("k").collect()
    assert [r["entry_index"] for r in rows] == list(range(500))
    sums = running_total(df.withColumn("v", F.lit(2)), "k", "v", "before", buckets=buckets).orderBy("k").collect()
    assert [r["before"] for r in sums] == [2 * i for i in range(500)]


def test_line_reader_numbers_split_files(spark, tmp_path):
    for name, n in (("a.jsonl", 400), ("b.jsonl", 90)):
        (tmp_path / name).write_text("".join(json.dumps({"n": i, "pad": "x" * 50}) + "\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = files.read_lines(spark, str(tmp_path))
        rows = df.select("source", "line", F.get_json_object("value", "$.n").cast("int").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 490 and all(r["line"] == r["n"] + 1 for r in rows)


def test_file_kinds_and_gate(spark, tmp_path):
    ok = json.dumps(chat("a", "b"))
    (tmp_path / "arr.json").write_text(f"[{ok}, {ok}]")
    (tmp_path / "mixed.json").write_text(f"[{ok}, 3]")
    (tmp_path / "obj.json").write_text(ok)
    (tmp_path / "odd.json").write_text('{"a": 1}')
    (tmp_path / "lines.txt").write_text(f"{ok}\n\nbad\n{ok}\n")
    (tmp_path / "bad.csv").write_text("x")
    (tmp_path / "latin.jsonl").write_bytes(b'{"a": "\xe9"}')
    (tmp_path / "pretty.json").write_text(json.dumps(chat("a", "b"), indent=1))
    (tmp_path / "many lines.json").write_text(f"\n{ok}\n{ok}\n")
    (tmp_path / "empty.jsonl").write_text("")

    def counts(rows):
        out = {}
        for r in rows.collect():
            key = r["source"].rsplit("/", 1)[1]
            good, bad = out.get(key, (0, 0))
            out[key] = (good + (r["record"] is not None), bad + (r["error"] is not None))
        return out

    want = {
        "arr.json": (2, 0), "mixed.json": (0, 1), "obj.json": (1, 0), "odd.json": (0, 1), "lines.txt": (2, 1),
        "pretty.json": (1, 0), "many%20lines.json": (2, 0),
    }
    assert counts(files.read_dataset(spark, str(tmp_path / "*.[jt]*[nt]"), layout="documents")) == want
    refused = {"bad.csv": (0, 1), "latin.jsonl": (0, 1)}
    assert counts(files.read_dataset(spark, str(tmp_path))) == want | refused
    gate = {r["source"].rsplit("/", 1)[1]: r["error"] for r in files.gate(spark, str(tmp_path)).collect()}
    assert gate["bad.csv"].startswith("Unsupported") and gate["latin.jsonl"] == "Not valid UTF-8" and gate["obj.json"] is None


def test_dialogue_ratio(spark):
    items = [chat("q", 'He said "hello" now'), chat("q", "no quotes"), chat("q", ""), chat("q", '"all"', "q", '"of it"')]
    got = col(qu.dialogue_ratios(entries(spark, items)), "ratio")
    assert got == [5 / 19, 0.0, 0.0, 8 / 13]
