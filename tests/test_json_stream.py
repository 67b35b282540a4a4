"""Arrays and objects in splits: every cut of a file gives the same records."""

import json
import random

import pytest

from parley.sources import files



def _value(rng, deep=0):
    kind = rng.random()
    if kind < 0.4 or deep > 3:
        return rng.choice(["plain", 'a "quoted" \\ word', "}{][", "\\\\", '\\"}', "é\n\t", "", 7, None, True, -1.5e3])
    if kind < 0.7:
        return [_value(rng, deep + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", 'k"', "}", "\\"]) + str(i): _value(rng, deep + 1) for i in range(rng.randrange(4))}


def _record(rng):
    return {"messages": _value(rng), "tags": [rng.choice(["x", "}", '"'])], "more": _value(rng)}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Arrays with every kind of spacing, objects, lines, and files that are broken or hold other items."""
    base, rng, want = tmp_path_factory.mktemp("docs"), random.Random(5), {}
    for i in range(12):
        items = [_record(rng) for _ in range(rng.choice([0, 1, 2, 40]))]
        indent = rng.choice([None, 2])
        (base / f"array-{i}.json").write_text(rng.choice(["", " \n"]) + json.dumps(items, indent=indent, ensure_ascii=bool(i % 2)) + rng.choice(["", "\n"]))
        want[f"array-{i}.json"] = [(n + 1, x, None) for n, x in enumerate(items)]
    item = _record(rng)
    for name, text, rows in (
        ("one.json", json.dumps(item, indent=1) + "\n", [(1, item, None)]),
        ("odd.json", json.dumps({"x": {"y": [1]}}, indent=1), [(None, None, "Object is not a training record")]),
        ("mixed.json", '[{"messages":[]}, 5, {"tags":["}"]}]', "mixed"), ("last.json", '[{"messages":[]}, "x"]', "mixed"),
        ("first.json", '["}", {"messages":[]}]', "mixed"), ("deep.json", '[[{"messages":[]}]]', "mixed"), ("numbers.json", "[1, 2]", "mixed"),
        ("short.json", '[{"messages":[]},\n{"tags":[]', "lines"), ("comma.json", '[{"messages":[]},]', "lines"), ("gap.json", '[{"messages":[]} {"messages":[]}]', "lines"),
        ("open.json", '[{"messages":[]}', "lines"), ("two.json", '[{"messages":[]}] [1]', "lines"), ("string.json", '[{"messages":"}', "lines"),
        ("lines.jsonl", '{"messages":[]}\n{"tags":[]}\n', "lines"), ("list.jsonl", '[{"messages":[1]}]', [(1, {"messages": [1]}, None)]),
    ):
        (base / name).write_text(text)
        want[name] = rows
        if rows == "mixed":
            want[name] = [(None, None, "Array holds items that are not objects")]
        elif rows == "lines":
            want[name] = []
            for n, line in enumerate(text.split("\n"), 1):
                try:
                    want[name] += [(n, json.loads(line), None)] if line else []
                except ValueError:
                    want[name].append((n, None, f"Line {n}: not valid JSON"))
    return base, want


def _read(spark, base):
    got = {}
    for r in files.read_dataset(spark, str(base)).collect():
        try:
            value = json.loads(r["record"]) if r["record"] else None
        except ValueError:
            value = r["record"]
        got.setdefault(r["source"].rsplit("/", 1)[1], []).append((r["line"], value, r["error"]))
    return {k: sorted(v, key=lambda x: x[0] or 0) for k, v in got.items()}


@pytest.mark.parametrize("split", [None, 150])
def test_records_of_all_files(spark, folder, split):
    base, want = folder
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    if split:
        for n in names:
            spark.conf.set(n, split)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = _read(spark, base)
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    want = {k: v for k, v in want.items() if v}
    assert {k: got.get(k) for k in want if got.get(k) != want[k]} == {} and set(got) == set(want)


def test_a_large_array_is_many_tasks(spark, tmp_path):
    """One file of one array, some 30 MB in 1 MB splits: many tasks, one name, records in order."""
    rng = random.Random(1)
    with open(tmp_path / "big.json", "w") as f:
        f.write("[")
        for i in range(30_000):
            f.write(("," if i else "") + json.dumps({"messages": [{"role": "user", "content": "}{\"" * rng.randrange(200)}], "id": i}))
        f.write("]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
        rows = files.read_dataset(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r["line"] for r in rows) == list(range(1, 30_001)) and not any(r["error"] for r in rows)
    assert all(json.loads(r["record"])["id"] == r["line"] - 1 for r in rows)
