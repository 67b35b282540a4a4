"""Small fixtures: entries from Python records through the JSON reader."""

import json

from pyspark.sql import functions as F

from parley.operators import entries as en


def records(spark, items):
    """``(entry_index, source, record)`` rows; strings are taken as JSON text."""
    rows = [(i, "t", x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, "entry_index long, source string, record string")


def entries(spark, items):
    return en.parse_entries(records(spark, items))


def chat(*turns, tags=(), system="You are a helpful guide who always answers in full sentences.", **extra):
    """A record with alternating user and assistant turns."""
    roles = ("user", "assistant")
    messages = [{"role": "system", "content": system}] if system is not None else []
    messages += [{"role": roles[i % 2], "content": t} for i, t in enumerate(turns)]
    return {"messages": messages, "tags": list(tags), **extra}


def pairs(df, column="messages"):
    """Messages of every entry as lists of (role, content)."""
    rows = df.orderBy("entry_index").collect()
    return [[(m["role"], m["content"]) for m in r[column]] for r in rows]


def json_of(df, **kw):
    rows = df.select("entry_index", en.entry_json(**kw).alias("j")).orderBy("entry_index").collect()
    return [json.loads(r["j"]) for r in rows]


def col(df, name, order="entry_index"):
    return [r[0] for r in df.orderBy(order).select(F.col(name)).collect()]
