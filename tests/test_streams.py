"""Each per-entry operator on a stream gives the rows of a batch read; batches sent again change nothing."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from parley.operators import characters as ch
from parley.operators import entries as en
from parley.operators import formats as fo
from parley.operators import normalize as no
from parley.operators import search as se
from parley.operators import tags as tg
from parley.operators import validate as va
from parley.plans import catalog_files as cf
from parley.plans import load
from parley.sources import files
from parley.streaming import batches as sb


def _texts():
    """Three files of lines: clean and faulty ChatML with equal lines, ShareGPT, and broken lines."""
    chat = lambda *turns, **extra: json.dumps({"messages": [{"role": r, "content": c} for r, c in turns], **extra})
    one = chat(("system", "You are kind and always answer in full."), ("USER", " hi "), ("Emma", "hello there"), tags=["Old Tag", "x", 3])
    same = chat(("user", "a refund please"), ("assistant", "As an AI language model, I cannot."), tags=["old"])
    share = json.dumps({"conversations": [{"from": "human", "value": "what"}, {"from": "gpt", "value": "that"}]})
    odd = json.dumps({"conversations": [{"from": "bob", "value": ""}, {"from": "system", "value": "late"}], "tags": ["old"]})
    return [[one, same, same, "", "{broken", same], [share, odd, share, share], [one, "7", chat(), "[1"]]


@pytest.fixture(scope="module")
def folder():
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    for i, lines in enumerate(_texts()):
        with open(os.path.join(base, f"part-{i}.jsonl"), "w") as f:
            f.write("\n".join(lines))
    return base


def _registry(spark):
    tags = spark.createDataFrame(
        [("new", "New", "c", 0, True, False, "active"), ("x", "X", None, 0, True, False, "archived")],
        "slug string, name string, category_slug string, sort_order int, is_active boolean, is_builtin boolean, status string",
    )
    cats = spark.createDataFrame([("c", "C", 0, True)], "slug string, name string, sort_order int, is_active boolean")
    life = spark.createDataFrame(
        [(1, "rename", "old", "new", "{}"), (2, "merge", "old_tag", "new", "{}")], "id long, action string, old_slug string, new_slug string, metadata_json string"
    )
    chars = spark.createDataFrame([("emma", "Emma", None, True), ("old", "Kind", None, False)], "slug string, display_name string, description string, is_active boolean")
    maps = spark.createDataFrame(
        [("u", 1, "emma", "assistant", "Em")], "entry_uuid string, turn_index int, character_slug string, training_role string, source_role_label string"
    )
    return tags, cats, life, chars, maps


def _steps(spark):
    tags, cats, life, chars, maps = _registry(spark)

    def aliases(r):
        rows = en.parse_entries(r)
        return tg.canonicalize_aliases(rows, tg.resolve_tags(tg.raw_tags(rows), tags, cats, life))

    return {
        "C1 record format": lambda r: r.withColumn("format", fo.detect_record_format(F.col("record"))),
        "C3 to chatml": fo.convert_to_chatml,
        "C4 to sharegpt": lambda r: fo.chatml_to_sharegpt(en.parse_entries(r)),
        "N2 roles": lambda r: no.normalize_roles(en.parse_entries(r)),
        "N3 trim": lambda r: no.trim_content(en.parse_entries(r)),
        "N4 baseline": lambda r: no.normalize_baseline(en.parse_entries(r)),
        "N7 tags": lambda r: no.normalize_tags(en.parse_entries(r)),
        "N8 load": load.entries_from_records,
        "V1 base": lambda r: va.analyze_base(en.parse_entries(r)),
        "V2 chatml": lambda r: va.analyze_chatml(en.parse_entries(r)),
        "V3 sharegpt": lambda r: va.analyze_sharegpt(r),
        "V7 repair": lambda r: va.repair_chatml(en.parse_entries(r)),
        "V8 repair sharegpt": lambda r: va.repair_sharegpt(r),
        "V9 inactive": lambda r: ch.inactive_references(no.ensure_entry_uuid(en.parse_entries(r)), chars).drop("entry_index"),
        "F1 search": lambda r: se.search(en.parse_entries(r), "refund"),
        "F5 filter": lambda r: se.filter_entries(en.parse_entries(r), tags=["old"], query="refund"),
        "R3 aliases": aliases,
        "P3 characters": lambda r: ch.normalize_known_characters(en.parse_entries(r), chars, maps)[0],
    }


def _rows(df):
    """Rows as JSON, without the position, which a stream numbers otherwise; ids derived from it go too."""
    cols = [c for c in df.columns if c not in ("entry_index", "batch", "entry_uuid", "meta", "v")]
    return sorted(r[0] for r in df.select(F.to_json(F.struct(*cols))).collect())


def test_all_steps_equal_the_batch(spark, folder):
    steps = _steps(spark)
    records = files.index_records(files.read_dataset(spark, folder, layout="lines"))
    out, state = (tempfile.mkdtemp(prefix="stream-", dir="/tmp") for _ in range(2))

    # all steps in one stream: every step writes its own folder from inside the batch
    def every(r):
        for name, step in steps.items():
            rows = step(r)
            rows.drop("v").write.mode("overwrite").parquet(f"{out}/{name.split()[0]}/batch={r.select(F.min('entry_index')).first()[0] or 0}")
        return r

    sb.run_stream(spark, folder, out, state, every, files_per_batch=2)
    assert sb.results(spark, out).select("batch").distinct().count() == 2
    for name, step in steps.items():
        want = _rows(step(records))
        assert _rows(spark.read.parquet(f"{out}/{name.split()[0]}")) == want, name
        assert want, name


def test_equal_lines_are_entries_of_their_own(spark, folder):
    out, state = (tempfile.mkdtemp(prefix="stream-", dir="/tmp") for _ in range(2))
    sb.run_stream(spark, folder, out, state, lambda r: r, files_per_batch=2)
    rows = sb.results(spark, out).collect()
    assert len(rows) == 11 == len({r["entry_index"] for r in rows})
    assert sorted((os.path.basename(r["source"]), r["line"]) for r in sb.results(spark, out, sb.ERRORS).collect()) == [("part-0.jsonl", 5), ("part-2.jsonl", 4)]


def test_a_batch_sent_again_replaces_itself(spark, folder):
    out = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    first = None
    for _ in range(2):  # a new state: the same files are batch 0 once more
        sb.run_stream(spark, folder, out, tempfile.mkdtemp(prefix="state-", dir="/tmp"), lambda r: r)
        rows = sorted(map(tuple, sb.results(spark, out).collect()))
        assert first is None or rows == first
        first = rows
    assert len(first) == 11


def test_many_files_are_a_few_batches(spark):
    source = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    for i in range(13):
        with open(os.path.join(source, f"part-{i:02}.jsonl"), "w") as f:
            f.write("".join(json.dumps({"messages": [{"role": "user", "content": f"{i} {k}"}]}) + "\n" for k in range(3)))
    rows = cf._streamed(spark, source, lambda r: r).collect()
    assert len({r["record"] for r in rows}) == len({r["entry_index"] for r in rows}) == len(rows) == 39
    assert 1 < len({r["batch"] for r in rows}) <= cf.BATCHES


def test_a_stream_walks_the_registry_once(spark, sf_dir, monkeypatch):
    walks, walk = [], tg.alias_targets
    monkeypatch.setattr(tg, "alias_targets", lambda *a: walks.append(1) or walk(*a))
    cf.stream_registry(spark, sf_dir).collect()
    assert len(walks) == 1


def test_a_batch_is_parsed_once(spark, folder):
    lines = spark.read.text(folder).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), "value")
    records, errors = sb.batch_records(lines, 1)
    assert (records.count(), errors.count()) == (11, 2)
    for frame in (records, errors):
        assert "parse_json" not in frame._jdf.queryExecution().toString()
