"""Registry of named queries and the SQL that checks them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import (
    ASSISTANT_SPELLINGS,
    SYSTEM_SPELLINGS,
    USER_SPELLINGS,
    WHITESPACE,
    WORD_PATTERN,
)
from .adapters import PROMPT, REFUSAL_PREFIX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with its SQL if there is one."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: wide_ints(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def wide_ints(df: DataFrame) -> DataFrame:
    """All integers as BIGINT, the type the checking SQL uses."""
    narrow = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, narrow) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# --- SQL snippets -----------------------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return ", ".join(lit(w) for w in words)


def strip(x: str) -> str:
    return f"trim({x}, {lit(WHITESPACE)})"


def std_role(x: str) -> str:
    key = f"lower({strip(x)})"
    return (
        f"CASE WHEN {key} IN ({in_list(USER_SPELLINGS)}) THEN 'user' "
        f"WHEN {key} IN ({in_list(ASSISTANT_SPELLINGS)}) THEN 'assistant' "
        f"WHEN {key} IN ({in_list(SYSTEM_SPELLINGS)}) THEN 'system' END"
    )


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(WORD_PATTERN)}))"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g'))"


def folded(x: str) -> str:
    return collapse(f"replace(lower({x}), 'ß', 'ss')")


def slug(x: str) -> str:
    return f"trim(regexp_replace(lower({strip(x)}), '[^a-z0-9]+', '_', 'g'), '_')"


def display(s: str) -> str:
    """Display name of a slug."""
    return (
        f"array_to_string(list_transform(string_split({s}, '_'), lambda w: CASE WHEN w IN ('ai','id','llm','rp') "
        "THEN upper(w) ELSE upper(w[1:1]) || w[2:] END), ' ')"
    )


CTES = {
    "raw": "SELECT conv_id AS e, turn AS i, role AS r, text AS c FROM conversations",
    "tsys": (
        "SELECT t.conv_id AS e, t.turn + CASE WHEN s.conv_id IS NULL THEN 1 ELSE 0 END AS i, t.role AS r, t.text AS c "
        "FROM conversations t LEFT JOIN (SELECT conv_id FROM conversations WHERE turn = 0 AND role = 'system') s "
        "ON t.conv_id = s.conv_id UNION ALL "
        f"SELECT conv_id, 0, 'system', {lit(PROMPT)} FROM conversations WHERE turn = 0 AND role <> 'system'"
    ),
    "dirty": (
        "SELECT e, i, CASE WHEN e % 7 = 1 THEN upper(r) WHEN e % 7 = 2 AND r = 'user' THEN 'human' "
        "WHEN e % 7 = 2 AND r = 'assistant' THEN 'gpt' WHEN e % 7 = 4 AND r = 'assistant' THEN 'Emma' ELSE r END AS r, "
        "CASE WHEN e % 7 = 3 THEN '  ' || c || ' ' || chr(10) WHEN e % 7 = 5 AND i = 2 THEN '' "
        f"WHEN e % 7 = 6 AND r = 'assistant' THEN {lit(REFUSAL_PREFIX)} || c ELSE c END AS c FROM tsys"
    ),
    "ids": "SELECT DISTINCT conv_id AS e FROM conversations",
    "tagrows": (
        "SELECT i.e, u.pos, CASE u.pos WHEN 0 THEN p_type WHEN 1 THEN p_brand ELSE p_name END AS tag FROM ids i "
        "JOIN part ON p_partkey = i.e % (SELECT count(*) FROM part) "
        "CROSS JOIN (SELECT unnest([0, 1, 2]) AS pos) u WHERE i.e % 5 <> 0"
    ),
    "slugs": (
        f"SELECT s AS slug, min(k) AS category_slug FROM (SELECT {slug('p_type')} AS s, 'kind' AS k FROM part "
        f"UNION ALL SELECT {slug('p_brand')}, 'brand' FROM part UNION ALL SELECT {slug('p_name')}, 'name' FROM part) GROUP BY s"
    ),
    "third": "SELECT slug, category_slug, ascii(right(slug, 1)) % 3 AS k FROM slugs",
    "reg": (
        f"SELECT slug, {display('slug')} AS name, CASE WHEN k = 0 THEN category_slug END AS category_slug, "
        "CASE WHEN k = 0 THEN 'active' ELSE 'archived' END AS status FROM third WHERE k <> 2"
    ),
    "alias": (
        "SELECT slug AS old_slug, 'brand_' || (CAST(right(slug, 1) AS INT) + 1) AS new_slug FROM slugs "
        "WHERE slug IN ('brand_1', 'brand_2', 'brand_3', 'brand_4', 'brand_5')"
    ),
    "chain": (
        "WITH RECURSIVE walk(slug, target, hops) AS (SELECT old_slug, new_slug, 1 FROM alias UNION ALL "
        "SELECT w.slug, a.new_slug, w.hops + 1 FROM walk w JOIN alias a ON a.old_slug = w.target "
        "WHERE w.hops < 20 AND NOT EXISTS (SELECT 1 FROM reg WHERE reg.slug = w.target AND reg.status = 'active')) "
        "SELECT w.slug, w.target FROM walk w JOIN reg ON reg.slug = w.target AND reg.status = 'active'"
    ),
    "resolved": (
        "SELECT u.tag, u.slug, CASE WHEN r.status = 'active' THEN 'active' WHEN c.target IS NOT NULL THEN 'alias_mapped' "
        "WHEN r.status = 'archived' THEN 'archived' WHEN t.k = 2 AND u.slug LIKE '%e' AND length(u.slug) % 2 = 0 THEN 'retired' ELSE 'unknown' END AS kind, "
        "CASE WHEN coalesce(r.status, '') <> 'active' AND c.target IS NOT NULL THEN c.target ELSE u.slug END AS resolved "
        f"FROM (SELECT DISTINCT tag, {slug('tag')} AS slug FROM tagrows) u LEFT JOIN reg r ON r.slug = u.slug "
        "LEFT JOIN chain c ON c.slug = u.slug LEFT JOIN third t ON t.slug = u.slug"
    ),
    "diag": "",  # set by the validation catalog
}
NEEDS = {
    "dirty": ("tsys",), "tagrows": ("ids",), "third": ("slugs",), "reg": ("third",), "alias": ("slugs",),
    "chain": ("alias", "reg"), "resolved": ("tagrows", "reg", "chain", "third"), "diag": ("dirty",),
}


def sql(body: str, *needs: str, **extra: str) -> str:
    """A statement with the common tables it needs in front."""
    order: list[str] = []

    def visit(name):
        for dep in NEEDS.get(name, ()):
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({s})" for n, s in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
