"""Merge, split, join, registry and near duplicates on small fixtures."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import chat, col, entries, pairs
from parley.operators import characters as ch
from parley.operators import entries as en
from parley.operators import mutate as mu
from parley.operators import neardup as nd
from parley.operators import quality as qu
from parley.operators import tags as tg
from parley.operators.multisearch import find_needles
from parley.plans import load
from parley.sources import sidecar


def ids(spark, *numbers):
    return spark.createDataFrame([(f"entry_index:{n}",) for n in numbers], "entry_id string")


def test_merge_keeps_the_first_and_unites_tags(spark):
    a = entries(spark, [chat("q", "a", tags=["x", "y"]), chat("q2", "a2", tags=["k", "k"])])
    b = entries(spark, [chat("q", "a", tags=["y", "z"], system="other prompt"), chat("q3", "a3")])
    merged = mu.merge_dedupe(mu.union_sources([a, b])).orderBy("file_order", "entry_index")
    rows = [(r["file_order"], r["entry_index"], r["tags"], r["copies"]) for r in merged.collect()]
    assert rows == [(0, 0, ["x", "y", "z"], 2), (0, 1, ["k", "k"], 1), (1, 1, [], 1)]
    assert tuple(mu.merge_counts(merged).first()) == (4, 1)


def test_merge_with_one_hot_key(spark):
    """Entries without user or assistant turns share one key."""
    n = 3000
    rows = spark.range(n).select(
        *en.entry_columns(
            F.col("id"),
            F.array(en.message(F.lit("system"), F.concat(F.lit("s"), F.col("id").cast("string")))),
            tags=F.array(F.concat(F.lit("t"), (F.col("id") % 5).cast("string"))),
        )
    )
    merged = mu.merge_dedupe(mu.union_sources([rows.repartition(17)])).collect()
    assert [(r["entry_index"], r["copies"], r["tags"]) for r in merged] == [(0, n, ["t0", "t1", "t2", "t3", "t4"])]


def test_split_then_join_restores_the_turns(spark):
    df = entries(spark, [chat("a", "b", "c", "d", "e", "f", tags=["t"]), chat("x", "y")])
    requests = spark.createDataFrame([("entry_index:0", [2, 1, 2]), ("entry_index:1", [1])], "entry_id string, split_points array<int>")
    maps = spark.createDataFrame(
        [("entry_index:0", i, "emma", "assistant", "Emma") for i in (2, 6)],
        "entry_uuid string, turn_index int, character_slug string, training_role string, source_role_label string",
    )
    out, rejects, moved = mu.split_entries(df, requests, maps)
    texts = [[c for _, c in p[1:]] for p in pairs(out)]
    assert texts == [["a", "b"], ["c", "d"], ["e", "f"], ["x", "y"]]
    assert [tuple(r) for r in rejects.collect()] == [("entry_index:1", "needs two complete exchanges")]
    assert sorted(r["turn_index"] for r in moved.collect()) == [2, 2]
    parts = out.where("entry_index < 3").select(
        F.lit(1).alias("group_id"), en.entry_id().alias("entry_id"), F.col("entry_index").alias("seq")
    )
    joined, report, back = mu.join_entries(out, parts, moved)
    assert [[c for _, c in p[1:]] for p in pairs(joined)] == [["a", "b", "c", "d", "e", "f"], ["x", "y"]]
    assert report.first()["reason"] is None and not report.first()["prompts_differ"]
    assert sorted(r["turn_index"] for r in back.collect()) == [2, 6]


def test_invalid_split_points(spark):
    df = entries(spark, [chat("a", "b", "c", "d")])
    for points in ([0], [2], [-1, 1], []):
        req = spark.createDataFrame([("entry_index:0", points)], "entry_id string, split_points array<int>")
        out, rejects, _ = mu.split_entries(df, req)
        assert rejects.first()["reason"] == "invalid split point" and out.count() == 1


def test_join_reports_problems(spark):
    df = entries(spark, [chat("a", "b"), chat("c", "d", system="Another prompt that differs."), chat("e", "f")])
    groups = spark.createDataFrame(
        [(1, "entry_index:1", 0), (1, "entry_index:0", 1), (1, "entry_index:1", 2), (2, "entry_index:2", 0), (3, "entry_index:2", 0), (3, "nobody", 1)],
        "group_id long, entry_id string, seq int",
    )
    out, report, _ = mu.join_entries(df, groups)
    assert [[c for _, c in p[1:]] for p in pairs(out)] == [["c", "d", "a", "b"], ["e", "f"]]
    got = {r["group_id"]: (r["prompts_differ"], r["reason"]) for r in report.collect()}
    assert got == {1: (True, None), 2: (False, "needs two entries"), 3: (False, "unknown entry")}


def test_tag_edits(spark):
    df = entries(spark, [chat("a", "b", tags=["x", "y"]), chat("c", "d", tags=[1, "z"])])
    assert col(mu.add_tags(df, ["y", "n"]), "tags") == [["x", "y", "n"], ["y", "n"]]
    assert col(mu.remove_tags(df, ["x"]), "tags") == [["y"], []]
    assert col(mu.replace_tags(df, ["New One", "new-one"], ids(spark, 0)), "tags")[0] == ["new_one"]


# --- registry ------------------------------------------------------------------------------


def registry(spark, alias_rows, tag_rows):
    cats = spark.createDataFrame([("c", "C", 0, True), ("off", "Off", 1, False)], "slug string, name string, sort_order int, is_active boolean")
    tags = spark.createDataFrame(
        [(s, s, c, 0, True, False, st) for s, c, st in tag_rows],
        "slug string, name string, category_slug string, sort_order int, is_active boolean, is_builtin boolean, status string",
    )
    life = spark.createDataFrame(
        [(i, a, o, n, "{}") for i, (a, o, n) in enumerate(alias_rows)],
        "id long, action string, old_slug string, new_slug string, metadata_json string",
    )
    return tags, cats, life


def test_tag_resolution(spark):
    chain = [("rename", f"h{i}", f"h{i + 1}") for i in range(25)]
    rows = chain + [
        ("rename", "old", "dead"), ("merge", "old", "Live One"), ("rename", "loop_a", "loop_b"), ("rename", "loop_b", "loop_a"),
        ("rename", "in_off", "hidden_cat"), ("delete", "gone", None), ("hide", "moved", "live_one"),
    ]
    tags, cats, life = registry(
        spark, rows,
        [("live_one", "c", "active"), ("h25", "c", "active"), ("hidden_cat", "off", "active"), ("arch", None, "archived"),
         ("un", None, "uncategorized"), ("hid", "c", "hidden")],
    )
    names = ["Live One", "old", "loop_a", "in_off", "arch", "un", "hid", "gone", "moved", "new", "??", "h5", "h4", "hidden_cat"]
    raw = spark.createDataFrame([(n,) for n in names], "tag string")
    got = {r["tag"]: (r["result_type"], r["resolved_slug"], r["reason"]) for r in tg.resolve_tags(raw, tags, cats, life).collect()}
    assert got == {
        "Live One": ("active", "live_one", "active_tag"),
        "old": ("alias_mapped", "live_one", "merge"),
        "loop_a": ("unknown", "loop_a", "unknown_tag"),
        "in_off": ("unknown", "in_off", "unknown_tag"),
        "arch": ("archived", "arch", "existing_archived"),
        "un": ("archived", "un", "existing_uncategorized"),
        "hid": ("hidden", "hid", "existing_hidden"),
        "gone": ("retired", "gone", "retired_history"),
        "moved": ("unknown", "moved", "unknown_tag"),
        "new": ("unknown", "new", "unknown_tag"),
        "??": ("unknown", "", "invalid_tag"),
        "h5": ("alias_mapped", "h25", "rename"),  # 20 hops
        "h4": ("alias_mapped", "h25", "rename"),  # 21 hops
        "hidden_cat": ("unknown", "hidden_cat", "unknown_tag"),
    }


def test_alias_rewrite(spark):
    df = entries(spark, [chat("a", "b", tags=["old", "x", "new", "x"]), chat("c", "d", tags=["x", "x"]), chat("e", "f", tags=[1, "old"])])
    resolved = spark.createDataFrame([("old", "new", True), ("x", "x", False)], "tag string, resolved_slug string, rewrite boolean")
    out = tg.canonicalize_aliases(df, resolved)
    assert col(out, "tags") == [["new", "x"], ["x", "x"], [None, "old"]]
    assert col(out, "rewrite_count") == [1, 0, 0]


def test_known_characters(spark):
    chars = spark.createDataFrame([("emma", "Emma Stone", None, True), ("bob", "Bob", None, False)], "slug string, display_name string, description string, is_active boolean")
    maps = spark.createDataFrame(
        [("u1", 2, "emma", "assistant", "Em"), ("u2", 1, "bob", "user", "Bob")],
        "entry_uuid string, turn_index int, character_slug string, training_role string, source_role_label string",
    )
    rules = ch.known_character_roles(chars, maps)
    assert sorted(r["key"] for r in rules.collect()) == ["em", "emma stone"]
    item = {"messages": [{"role": r, "content": "x"} for r in ("system", "Bob", " EM ", "user", "emma stone")], "tags": []}
    out, rows = ch._rewrite(entries(spark, [item]), rules, fold=True)
    assert [r for r, _ in pairs(out)[0]] == ["system", "Bob", "assistant", "user", "assistant"]
    assert sorted((r["turn_index"], r["source_role_label"]) for r in rows.collect()) == [(2, "EM"), (4, "emma stone")]


def test_inactive_references(spark):
    names = ["Al", "X", "Anna Lee", "Zed", "ß", "Absent"]
    chars = spark.createDataFrame([(n.lower(), n, None, n == "Zed") for n in names], "slug string, display_name string, description string, is_active boolean")
    prompts = ["anna LEE and Zed", "exit", "STRASSE", "q", ""]
    items = [chat("a", "b", system=p, _entry_meta={"entry_uuid": f"u{i}"}) for i, p in enumerate(prompts)]
    got = ch.inactive_references(entries(spark, items), chars)
    want = {(i, n) for i, p in enumerate(prompts) for n in names if n != "Zed" and n.casefold() in p.casefold()}
    assert {(r["entry_index"], r["character"]) for r in got.collect()} == want


def test_inactive_references_in_long_messages(spark):
    """A message of a megabyte, many names and parts of them: the work follows the text."""
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abc ") for _ in range(rng.randrange(1, 7))).strip() or "a" for _ in range(300)})
    rows = spark.createDataFrame([(n,) for n in names], "needle string")
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (0, 3, 50, 1_000_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {(i, n) for i, t in enumerate(texts) for n in names if n in t}
    for part in (50_000, 40):
        assert {tuple(r) for r in find_needles(df, rows, part=part).collect()} == want


def test_aliases_do_not_leak_between_sources(spark):
    """Entries of several sources may share a position; each is rewritten by its own tags."""
    one = entries(spark, [chat("a", "b", tags=["old", "x"])])
    two = entries(spark, [chat("a", "b", tags=["b", "x"])]).withColumn("source", F.lit("other"))
    three = one.withColumn("source", F.lit(None).cast("string"))
    resolved = spark.createDataFrame([("old", "new", True)], "tag string, resolved_slug string, rewrite boolean")
    out = tg.canonicalize_aliases(one.unionByName(two).unionByName(three), resolved)
    got = {r["source"]: (list(r["tags"]), r["rewrite_count"]) for r in out.collect()}
    assert got == {"t": (["new", "x"], 1), "other": (["b", "x"], 0), None: (["new", "x"], 1)}


def test_merged_datasets_are_numbered_as_one(spark):
    a = entries(spark, [chat("a", "b"), chat("c", "d"), chat("a", "b")])
    b = entries(spark, [chat("c", "d"), chat("e", "f"), chat("g", "h")]).withColumn("source", F.lit("u"))
    rows = mu.merge_datasets([a, b]).orderBy("entry_index").collect()
    assert [r["entry_index"] for r in rows] == [0, 1, 2, 3]
    assert [r["messages"][1]["content"] for r in rows] == ["a", "c", "e", "g"]
    assert [r["copies"] for r in rows] == [2, 2, 1, 1]


def test_near_duplicates_over_several_sources(spark):
    """Positions of a load are unique over its files, so sets keep their own ids."""
    from parley.sources import files

    text = " ".join(f"w{i}" for i in range(40))
    docs = {"a": [text, "alone one"], "b": [text, "alone two"], "c": ["alone three"]}
    rows = [(s, i + 1, json.dumps(chat(t, "answer " + t)), None) for s, ts in docs.items() for i, t in enumerate(ts)]
    parsed = spark.createDataFrame(rows, "source string, line long, record string, error string")
    loaded = en.parse_entries(files.index_records(parsed))
    assert sorted(r["entry_index"] for r in loaded.collect()) == list(range(5))
    sets = nd.distinct_sets(nd.word_sets(nd.entry_texts(loaded)))
    assert sets.count() == sets.select("set_id").distinct().count() == 4


def test_sidecar_is_one_document(spark, tmp_path):
    maps = spark.createDataFrame(
        [(f"u{i}", t, "emma", "assistant", None) for i in range(40) for t in (2, 4)],
        "entry_uuid string, turn_index int, character_slug string, training_role string, source_role_label string",
    )
    frames = {
        "mappings": maps,
        "characters": spark.createDataFrame([("emma", "Emma", None, True)], "slug string, display_name string, description string, is_active boolean"),
        "categories": spark.createDataFrame([("c", "C", 0, True, False)], "slug string, name string, sort_order int, is_active boolean, is_builtin boolean"),
        "tags": spark.createDataFrame([("t", "T", "c", 0, "active", True, False)], "slug string, name string, category_slug string, sort_order int, status string, is_active boolean, is_builtin boolean"),
        "aliases": spark.createDataFrame([("o", "rename", "t")], "old_slug string, action string, new_slug string"),
        "system_prompts": spark.createDataFrame([("p", "P", "text", None, True)], "slug string, name string, content string, description string, is_active boolean"),
    }
    dataset = spark.createDataFrame([("d1", "f.jsonl", 40)], "dataset_uuid string, filename string, entry_count long")
    usage = spark.createDataFrame([("t", 3)], "slug string, entries long")
    for partitions, path in ((1, tmp_path / "one.json"), (7, tmp_path / "many.json")):
        for _ in range(2):  # the second replaces the first
            sidecar.write_sidecar(sidecar.sidecar_lines(dataset, frames, usage, exported_at="now"), str(path), partitions=partitions)
        text = json.loads(path.read_text())
        assert text["dataset"]["tag_usage_counts"] == {"t": 3} and len(text["entry_character_mappings"]) == len({m["entry_uuid"] for m in text["entry_character_mappings"]})
        parsed = sidecar.read_sidecars(spark, str(path))
        assert parsed.count() == 1 and parsed.where(F.size("errors") > 0).count() == 0
        back = sidecar.sidecar_frames(parsed)
        assert back["mappings"].count() == 80
        assert [back[n].count() for n in ("tags", "categories", "aliases", "characters", "system_prompts")] == [1] * 5
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["many.json", "one.json"]
    # nothing to list
    empty = {k: v.where("false") for k, v in frames.items()}
    sidecar.write_sidecar(sidecar.sidecar_lines(dataset, empty, usage.where("false"), exported_at="now"), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text())["tags"] == []


def test_finalize_a_load(spark):
    tags, cats, life = registry(spark, [("rename", "old", "live")], [("live", "c", "active")])
    chars = spark.createDataFrame([("emma", "Emma", None, True)], "slug string, display_name string, description string, is_active boolean")
    maps = spark.createDataFrame(
        [("u1", 2, "emma", "assistant", "Em")],
        "entry_uuid string, turn_index int, character_slug string, training_role string, source_role_label string",
    )
    item = chat("a", "b", tags=["old", "brand new"])
    item["messages"][2]["role"] = "Emma"
    reg = {"tags": tags, "categories": cats, "lifecycle": life, "characters": chars, "mappings": maps}
    rows, out = load.finalize(entries(spark, [item]), reg)
    r = rows.first()
    assert r["tags"] == ["live", "brand new"] and r["messages"][2]["role"] == "assistant" and len(r["meta"]["entry_uuid"]) == 36
    assert out["mappings"].count() == 2
    assert {t["slug"]: t["status"] for t in out["tags"].collect()} == {"live": "active", "brand_new": "archived"}


# --- near duplicates -----------------------------------------------------------------------------


def _random_sets(seed, n=140):
    """Families of edited copies over sizes from 1 to 400 words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    out = []
    while len(out) < n:
        base = rng.sample(words, rng.choice([1, 5, 9, 10, 11, 12, 15, 18, 19, 20, 21, 25, 40, 90, 180, 400]))
        for _ in range(rng.randint(1, 4)):
            copy = set(base)
            for _ in range(rng.randint(0, 1 + len(base) // 14)):
                if rng.random() < 0.5 and len(copy) > 1:
                    copy.discard(rng.choice(sorted(copy)))
                else:
                    copy.add(rng.choice(words))
            out.append(sorted(copy))
    return out


def _brute(sets):
    found = set()
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            x, y = set(a), set(sets[j])
            if 10 * len(x & y) > 9 * len(x | y):
                found.add((i, j))
    return found


@pytest.mark.parametrize("seed,block,partitions", [(1, 2000, 8), (2, 3, 1), (3, 1, 64), (4, 50, 4)])
def test_near_duplicates_equal_brute_force(spark, seed, block, partitions):
    sets = _random_sets(seed)
    texts = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "entry_index long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        groups, similar = nd.near_duplicates(texts, block=block)
        summary = nd.near_duplicate_summary(groups, similar).first()
        edges = [(r["left_id"], r["right_id"]) for r in similar.collect()]
        flagged = {r[0] for r in nd.near_duplicate_entries(texts, groups, similar).collect()}
        banded = {(r["left_id"], r["right_id"]) for r in nd.banded(groups, similar).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = _brute(sets)
    assert (summary["pair_count"], summary["duplicate_entries"]) == (len(want), len({i for p in want for i in p}))
    assert flagged == {i for p in want for i in p}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    different = {(a, b) for a, b in want if first[tuple(sets[a])] == a and first[tuple(sets[b])] == b and sets[a] != sets[b]}
    assert len(edges) == len(set(edges)) and set(edges) == different

    def simhash(tokens):
        votes = [0] * 64
        for t in tokens:
            h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
            for b in range(64):
                votes[b] += 1 if h >> b & 1 else -1
        return sum(1 << b for b in range(64) if votes[b] >= 0)

    bands = lambda i: {(s, simhash(sets[i]) >> s & 0xFFFF) for s in (0, 16, 32, 48)}
    assert banded == {(a, b) for a, b in different if bands(a) & bands(b)}


def test_one_hot_set_is_one_row(spark):
    texts = spark.range(2000).select(F.col("id").alias("entry_index"), F.lit("the same words again and again in every single entry of this").alias("text"))
    groups, similar = nd.near_duplicates(texts)
    assert groups.count() == 1 and similar.count() == 0
    assert tuple(nd.near_duplicate_summary(groups, similar).first()) == (2000 * 1999 // 2, 2000)


def test_a_sidecar_is_parsed_once(spark, sf_dir, monkeypatch):
    """Later uses of its frames and of the registry read rows, not the document or the table of turns."""
    from parley.plans import adapters as ad
    from parley.plans import catalog_files as cf

    reads, table = [], ad.table
    monkeypatch.setattr(ad, "table", lambda s, d, name: reads.append(name) or table(s, d, name))
    kept = cf._written_registry(spark, sf_dir)
    n = len(reads)
    side = cf._written_sidecar(spark, sf_dir, kept)
    assert set(reads[n:]) == {"conversations", "part"} and reads[n:].count("part") == 2  # tags of the entries alone
    for frame in (*side.values(), *kept.values()):
        assert frame.inputFiles() and all(f.endswith(".parquet") for f in frame.inputFiles())


def test_near_duplicates_read_written_words(spark):
    """Texts are read once for sets, pairs and entries; only numbers of signatures and words of candidates move."""
    from pyspark.sql.types import LongType

    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    sets = _random_sets(5)
    made = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets + sets[:7])], "entry_index long, text string")
    written = nd.written_sets(made.mapInArrow(read, "entry_index long, text string"))
    groups, similar = nd.near_duplicates(written)
    flagged = {r[0] for r in nd.near_duplicate_entries(written, groups, similar).collect()}
    n_pairs = nd.near_duplicate_summary(groups, similar).first()["pair_count"]
    assert seen.value == len(sets) + 7
    want = _brute(sets + sets[:7])
    assert (n_pairs, flagged) == (len(want), {i for p in want for i in p})
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(similar) == pairs(nd.similar_sets(groups, group=5))  # families cut into many groups
    rows = nd.signature_rows(groups).toPandas()
    assert (rows.groupby("set_id")["n"].count() == 1).all() and isinstance(groups.schema["copies"].dataType, LongType)


def test_entropy_and_grades(spark):
    even = spark.createDataFrame([("a", 2), ("b", 2)], "tag string, uses long")
    one = spark.createDataFrame([("a", 2)], "tag string, uses long")
    assert qu.tag_entropy(even).first()[0] == 1.0 and qu.tag_entropy(one).first()[0] == 0.0
    scores = spark.createDataFrame([(90.0,), (89.99,), (50.0,), (30.0,), (0.0,)], "s double")
    assert [r[0] for r in scores.select(qu.grade(F.col("s"))).collect()] == ["Excellent", "Good", "Fair", "Needs Attention", "Significant Issues"]
