"""Queries: files, load, sidecar, registry exchange, export, streaming."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import characters as ch
from ..operators import entries as en
from ..operators import mutate as mu
from ..operators import normalize as no
from ..operators import registry as rg
from ..operators import tags as tg
from ..session import cut_lineage, scratch_path
from ..sources import files, sidecar
from ..streaming import batches as sb
from ..streaming import entries as se
from . import adapters as ad
from . import catalog_mutate, catalog_tags, catalog_validate  # noqa: F401  (shared SQL)
from . import load
from .base import CTES, NEEDS, lit, query, slug, sql, std_role, strip
from .catalog_entries import NORMAL_ROLE, _fingerprint

PER_DOCUMENT = 1000  # entries of one array document at most
BATCHES = 4  # micro-batches of a streamed folder; a batch is then work for all cores, whatever the number of files
KINDS = "SELECT e, e % 10 AS k, count(*) AS n FROM tsys GROUP BY e"
CTES["kinds"] = KINDS
NEEDS["kinds"] = ("tsys",)


def _lines(spark, sf):
    """Records as numbered text lines."""
    return ad.records(spark, sf).select("source", (F.col("entry_index") + 1).alias("line"), F.col("record").alias("value"))


def _written_lines(spark, sf):
    """The record lines as text files in the shared folder."""
    path = scratch_path(spark, "lines")
    rows = ad.records(spark, sf).repartitionByRange("entry_index").sortWithinPartitions("entry_index")
    rows.select("record").write.text(path)
    return path


@query("read_jsonl", sql(
    "SELECT e + 1 AS line, k <> 8 AS parsed, CASE WHEN k = 8 THEN 'Line ' || (e + 1) || ': not valid JSON' END AS error FROM kinds", "kinds"))
def read_jsonl(spark, sf):
    return files.parse_lines(_lines(spark, sf)).select("line", F.col("record").isNotNull().alias("parsed"), "error")


@query("read_counts", sql(
    "SELECT 'table' AS source, count(*) AS source_line_count, count(*) FILTER (k <> 8) AS parsed_entry_count, count(*) FILTER (k = 8) AS parse_error_count, "
    "false AS no_valid FROM kinds", "kinds"))
def read_counts(spark, sf):
    return files.read_counts(files.parse_lines(_lines(spark, sf)))


@query("entry_index", sql(
    "SELECT e + 1 AS line, row_number() OVER (ORDER BY e) - 1 AS entry_index FROM kinds WHERE k <> 8", "kinds"))
def entry_index(spark, sf):
    """Dense positions of the good lines."""
    return files.index_records(files.parse_lines(_lines(spark, sf))).select("line", "entry_index")


def _three_sources(spark, sf):
    """The record lines dealt to three sources, with line numbers that collide."""
    lines = _lines(spark, sf)
    e = F.col("line") - 1
    return lines.select(
        F.concat(F.lit("part-"), (e % 3).cast("string"), F.lit(".jsonl")).alias("source"),
        (F.floor(e / 3) + 1).alias("line"), "value",
    )


@query("index_sources", sql(
    "SELECT 'part-' || e % 3 || '.jsonl' AS source, e // 3 + 1 AS line, row_number() OVER (ORDER BY e % 3, e) - 1 AS entry_index FROM kinds WHERE k <> 8", "kinds"))
def index_sources(spark, sf):
    """One dense position over the good lines of several sources."""
    return files.index_records(files.parse_lines(_three_sources(spark, sf))).select("source", "line", "entry_index")


@query("delete_from_sources", sql(
    "SELECT i AS entry_index, source FROM (SELECT 'part-' || e % 3 || '.jsonl' AS source, row_number() OVER (ORDER BY e % 3, e) - 1 AS i FROM kinds WHERE k <> 8) "
    "WHERE i % 4 <> 0", "kinds"))
def delete_from_sources(spark, sf):
    """An id derived from a position names one entry, whatever the number of sources."""
    entries = en.parse_entries(files.index_records(files.parse_lines(_three_sources(spark, sf))))
    ids = entries.where(F.col("entry_index") % 4 == 0).select(F.concat(F.lit("entry_index:"), F.col("entry_index").cast("string")).alias("entry_id"))
    return mu.delete_entries(entries, ids).select("entry_index", "source")


@query("read_files", sql(
    "SELECT count(*) AS lines, count(*) FILTER (k <> 8) AS records, count(*) FILTER (k = 8) AS errors, true AS dense FROM kinds", "kinds"))
def read_files(spark, sf):
    """Lines written to files and read back with line numbers per file."""
    parsed = files.read_dataset(spark, _written_lines(spark, sf))
    per_file = parsed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.max("line").alias("last"), F.count("record").alias("r"), F.count("error").alias("x")
    )
    return per_file.agg(
        F.sum("n").alias("lines"), F.sum("r").alias("records"), F.sum("x").alias("errors"),
        F.bool_and(F.col("n") == F.col("last")).alias("dense"),
    )


def _array_documents(rows):
    """``doc, part, first, value``: array documents of bounded size, ``first`` entries of the same ``doc`` before each."""
    docs = rows.groupBy((F.col("entry_index") % 4).alias("doc"), F.floor(F.col("entry_index") / (4 * PER_DOCUMENT)).alias("part")).agg(
        F.count(F.lit(1)).alias("n"),
        F.concat(
            F.lit(" ["),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry_index", "j"))), lambda x: x["j"]), ", "),
            F.lit("]\n"),
        ).alias("value"),
    )
    line = Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = docs.select("doc", "part", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("first"))  # numbers alone
    return docs.drop("n").join(first, ["doc", "part"])


@query("read_json_array", sql(
    "SELECT e % 4 AS doc, row_number() OVER (PARTITION BY e % 4 ORDER BY e) AS line, (SELECT count(*) FROM tsys t WHERE t.e = kinds.e) AS n_messages FROM kinds", "kinds", "tsys"))
def read_json_array(spark, sf):
    """The entries of each residue of four as array documents, their lines numbered on from one to the next."""
    docs = _array_documents(ad.entries_sys(spark, sf).select("entry_index", en.entry_json().alias("j")))
    parsed = files.parse_documents(docs.select(F.concat_ws(".", "doc", "part", "first").alias("source"), "value"))
    out = en.parse_entries(parsed.select(F.col("line").alias("entry_index"), "source", "record"))
    name = lambda i: F.split_part("source", F.lit("."), F.lit(i)).cast("long")
    return out.select(name(1).alias("doc"), (F.col("entry_index") + name(3)).alias("line"), F.size("messages").alias("n_messages"))


@query("read_json_object", sql(
    "SELECT e AS entry_index, k NOT IN (4, 8) AS loaded, CASE k WHEN 4 THEN 'Object is not a training record' WHEN 8 THEN 'Line 1: not valid JSON' END AS error FROM kinds", "kinds"))
def read_json_object(spark, sf):
    """Every record as a document of its own."""
    docs = ad.records(spark, sf).select(
        F.concat(F.col("entry_index").cast("string"), F.lit(".json")).alias("source"), F.col("record").alias("value")
    )
    out = files.parse_whole(docs)
    return out.select(
        F.split_part("source", F.lit("."), F.lit(1)).cast("long").alias("entry_index"), F.col("record").isNotNull().alias("loaded"), "error"
    )


@query("read_gate", sql(
    "SELECT kind, error AS least, error AS most FROM (VALUES ('lines', 'fine'), ('table', 'Unsupported file type: .csv'), ('bytes', 'Not valid UTF-8')) v(kind, error) "
    "WHERE (SELECT count(*) FROM kinds) > 0", "kinds"))
def read_gate(spark, sf):
    """All records as files of lines, as files of another type, and with a byte that is no UTF-8."""
    base = scratch_path(spark, "gate")
    rows = ad.records(spark, sf).select("record")
    rows.write.text(f"{base}/lines")
    rows.write.csv(f"{base}/table")
    rows.select(F.concat(F.col("record").cast("binary"), F.unhex(F.lit("E9"))).cast("string").alias("record")).write.text(f"{base}/bytes")
    kind, error = F.regexp_extract("source", "/([a-z]+)/[^/]+$", 1), F.coalesce("error", F.lit("fine"))
    return files.gate(spark, f"{base}/*").groupBy(kind.alias("kind")).agg(F.min(error).alias("least"), F.max(error).alias("most"))


@query("sidecar_path", sql("SELECT '/data/' || e || '.v1.registry.json' AS path FROM ids", "ids"))
def sidecar_path(spark, sf):
    rows = ad.table(spark, sf, "conversations").select("conv_id").distinct()
    return rows.select(files.sidecar_path(F.concat(F.lit("/data/"), F.col("conv_id").cast("string"), F.lit(".v1.jsonl"))).alias("path"))


@query("write_jsonl", sql(
    "SELECT e AS entry_index, md5(string_agg(r || chr(1) || c, chr(2) ORDER BY i)) AS fingerprint FROM dirty GROUP BY e", "dirty"))
def write_jsonl(spark, sf):
    """Write the dirty entries as JSON lines and read them back in order."""
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(ad.entries_dirty(spark, sf), path)
    lines = files.read_lines(spark, path)
    # part files are in order, so is the position over all of them
    parsed = files.index_records(files.parse_lines(lines))
    return en.parse_entries(parsed).select("entry_index", _fingerprint().alias("fingerprint"))


@query("export_clean", sql(
    "SELECT e AS entry_index, count(*) AS n_messages, 1 AS n_keys FROM tsys WHERE e % 2 = 0 GROUP BY e", "tsys"))
def export_clean(spark, sf):
    """Selected ids win over the filtered ones; only messages are exported."""
    rows = ad.entries_tagged(spark, sf)
    ids = rows.select(en.entry_id().alias("entry_id"), "entry_index")
    out = files.export_rows(rows, selected=ids.where("entry_index % 2 = 0"), filtered=ids.where("entry_index % 5 = 0"))
    return out.select(
        "entry_index", F.json_array_length(F.get_json_object("value", "$.messages")).alias("n_messages"),
        F.size(F.json_object_keys("value")).alias("n_keys"),
    )


@query("export_sharegpt", sql(
    f"SELECT e AS entry_index, count(*) FILTER ({std_role('r')} IS NOT NULL) AS turns FROM dirty GROUP BY e", "dirty"))
def export_sharegpt(spark, sf):
    out = files.export_rows(ad.entries_dirty(spark, sf), fmt="sharegpt")
    return out.select("entry_index", F.json_array_length(F.get_json_object("value", "$.conversations")).alias("turns"))


# --- load ---------------------------------------------------------------------------------------


@query("load_pipeline", sql(
    f"SELECT row_number() OVER (ORDER BY d.e) - 1 AS entry_index, CASE WHEN k IN (0, 1, 2, 6, 9) THEN md5(string_agg({NORMAL_ROLE} || chr(1) || {strip('c')}, chr(2) ORDER BY i)) END AS fingerprint, "
    "max(CASE WHEN k IN (0, 1, 3, 6) THEN '' WHEN k = 2 THEN 'a,b' WHEN k = 4 THEN 'a' WHEN k = 7 THEN 's' WHEN k = 9 THEN coalesce(g.tags, '') END) AS tags "
    f"FROM dirty d JOIN kinds USING (e) LEFT JOIN (SELECT e, string_agg({slug('tag')}, ',' ORDER BY pos) AS tags FROM tagrows GROUP BY e) g ON g.e = d.e "
    "WHERE k <> 8 GROUP BY d.e, k", "dirty", "kinds", "tagrows"))
def load_pipeline(spark, sf):
    """JSON lines to clean entries: all records, and the bad lines left out by the reader."""
    out = load.entries_from_records(files.index_records(files.parse_lines(_lines(spark, sf))))
    return out.select("entry_index", _fingerprint().alias("fingerprint"), F.array_join("tags", ",").alias("tags"))


@query("load_summary", sql(
    "SELECT count(*) AS source_line_count, count(*) FILTER (k <> 8) AS parsed_entry_count, count(*) FILTER (k = 8) AS parse_error_count, "
    "count(*) FILTER (k IN (0, 1)) AS structural_changed_entries, 2 * count(*) FILTER (k = 2) AS dropped_tags FROM kinds", "kinds"))
def load_summary(spark, sf):
    parsed = files.parse_lines(_lines(spark, sf))
    rows = load.entries_from_records(files.index_records(parsed))
    return load.load_summary(rows, parsed).select(
        "source_line_count", "parsed_entry_count", "parse_error_count", "structural_changed_entries", "dropped_tags"
    )


# --- sidecar and registry exchange ---------------------------------------------------------------------


def registry(spark, sf) -> dict:
    """The full registry frames of the adapters."""
    prompts = ad.entries_sys(spark, sf).select(
        F.sha1(F.get("messages", F.lit(0))["content"]).alias("slug"), F.get("messages", F.lit(0))["content"].alias("content")
    ).distinct()
    return {
        "categories": ad.categories(spark, sf),
        "tags": ad.tags(spark, sf),
        "lifecycle": ad.lifecycle(spark, sf),
        "characters": ad.characters(spark, sf),
        "mappings": ad.mappings(spark, sf),
        "system_prompts": prompts.select(
            "slug", F.lit("Prompt").alias("name"), "content", F.lit(None).cast("string").alias("description"),
            F.lit(True).alias("is_active"),
        ),
    }


def _written_registry(spark, sf) -> dict:
    """The same frames written once, for queries that read them many times."""
    return {k: cut_lineage(v) for k, v in registry(spark, sf).items()}


def _usage(spark, sf, kept=None):
    kept = kept or registry(spark, sf)
    resolved = tg.resolve_tags(tg.raw_tags(ad.entries_tagged(spark, sf)), kept["tags"], kept["categories"], kept["lifecycle"])
    return tg.tag_usage_counts(ad.entries_tagged(spark, sf), resolved)


def _uuids(spark, sf):
    rows = ad.table(spark, sf, "conversations").select("conv_id").distinct()
    return rows.select(ad.uuid_of(F.col("conv_id")).alias("entry_uuid"))


def _exported(spark, sf, kept=None, usage=None):
    kept = kept or registry(spark, sf)
    return rg.export_registry(kept, _usage(spark, sf, kept) if usage is None else usage, _uuids(spark, sf))


USED = "SELECT DISTINCT resolved AS slug FROM tagrows t JOIN resolved r ON r.tag = t.tag"


@query("export_registry", sql(
    "SELECT 'tags' AS part, count(*) AS rows FROM reg WHERE slug IN (SELECT slug FROM used) UNION ALL "
    "SELECT 'categories', count(DISTINCT category_slug) FROM reg WHERE slug IN (SELECT slug FROM used) UNION ALL "
    "SELECT 'aliases', count(*) FROM alias WHERE old_slug IN (SELECT slug FROM used) OR new_slug IN (SELECT slug FROM used) UNION ALL "
    "SELECT 'characters', count(DISTINCT slug) FROM maps UNION ALL SELECT 'mappings', count(*) FROM maps UNION ALL "
    "SELECT 'system_prompts', count(DISTINCT c) FROM tsys WHERE i = 0", "reg", "resolved", "alias", "maps", "tsys", used=USED))
def export_registry(spark, sf):
    out = None
    for name, df in _exported(spark, sf).items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def _side_frames(spark, sf, kept=None, usage=None) -> dict:
    frames = dict(_exported(spark, sf, kept, usage))
    frames["categories"] = frames["categories"].withColumn("is_builtin", F.lit(False))
    return frames


def _written_sidecar(spark, sf, kept=None):
    """The document written as one file to the shared folder and read back."""
    kept = kept or _written_registry(spark, sf)
    usage = cut_lineage(_usage(spark, sf, kept))
    dataset = ad.table(spark, sf, "conversations").agg(F.count_distinct("conv_id").alias("entry_count")).select(
        F.lit("dataset-1").alias("dataset_uuid"), F.lit("data.jsonl").alias("filename"), "entry_count"
    )
    path = scratch_path(spark, "sidecar")
    lines = sidecar.sidecar_lines(dataset, _side_frames(spark, sf, kept, usage), usage, exported_at="2024-01-01T00:00:00Z")
    sidecar.write_sidecar(lines, path)
    return sidecar.read_frames(spark, path)


@query("sidecar_round_trip", sql(
    "SELECT 'tags' AS part, slug FROM reg WHERE slug IN (SELECT slug FROM used) UNION ALL SELECT 'characters', slug FROM (SELECT DISTINCT slug FROM maps) UNION ALL "
    "SELECT 'mappings', u || '#' || i FROM maps UNION ALL SELECT 'aliases', old_slug FROM alias WHERE old_slug IN (SELECT slug FROM used) OR new_slug IN (SELECT slug FROM used)",
    "reg", "resolved", "alias", "maps", used=USED))
def sidecar_round_trip(spark, sf):
    """Build the sidecar document, parse and validate it, list its contents."""
    f = _written_sidecar(spark, sf)
    part = lambda name, col: f[name].select(F.lit(name).alias("part"), col.alias("slug"))
    return (
        part("tags", F.col("slug")).unionByName(part("characters", F.col("slug")))
        .unionByName(part("mappings", F.concat_ws("#", "entry_uuid", F.col("turn_index").cast("string"))))
        .unionByName(part("aliases", F.col("old_slug")))
    )


@query("sidecar_faults", sql(
    "SELECT e AS entry_index, CASE e % 5 WHEN 0 THEN '' WHEN 1 THEN 'metadata,metadata.schema_version,metadata.kind,metadata.exported_at' WHEN 2 THEN 'unsupported kind' "
    "WHEN 3 THEN 'dataset.entry_count' ELSE 'tags: name' END AS errors FROM ids", "ids"))
def sidecar_faults(spark, sf):
    """One small document per conversation with a fault chosen by its number."""
    e = F.col("conv_id").cast("string")
    rows = ad.table(spark, sf, "conversations").select("conv_id").distinct()
    head = '"metadata":{"schema_version":1,"kind":"%s","exported_at":"x"}'
    data = lambda n: F.concat(F.lit(',"dataset":{"dataset_uuid":"d'), e, F.lit('","filename":"f","entry_count":' + n + "}"))
    wrap = lambda *parts: F.concat(F.lit("{"), *parts, F.lit("}"))
    good, other = F.lit(head % sidecar.KIND), F.lit(head % "other")
    k = F.col("conv_id") % 5
    value = (
        F.when(k == 0, wrap(good, data("1"), F.lit(',"tags":[{"slug":"a","name":"A","category_slug":null}]')))
        .when(k == 1, wrap(F.substr(data("1"), F.lit(2))))
        .when(k == 2, wrap(other, data("1")))
        .when(k == 3, wrap(good, data('"1"')))
        .otherwise(wrap(good, data("1"), F.lit(',"tags":[{"slug":"a","name":""}]')))
    )
    parsed = sidecar.parse_sidecars(rows.select(e.alias("source"), value.alias("value")))
    return parsed.select(F.col("source").cast("long").alias("entry_index"), F.array_join("errors", ",").alias("errors"))


def _other_registry(spark, sf, kept=None) -> dict:
    """A registry that shares some tags, with other states."""
    r = dict(kept or registry(spark, sf))
    kind = F.length("slug") % 4
    r["tags"] = r["tags"].where(kind != 0).withColumn(
        "category_slug", F.when(kind == 1, F.lit("kind")).when(kind == 2, F.lit(None)).otherwise(F.col("category_slug"))
    ).withColumn("status", F.when(kind == 2, "archived").when(kind == 1, "active").otherwise(F.col("status")))
    r["categories"] = r["categories"].where("slug <> 'name'")
    r["characters"] = r["characters"].where("slug <> 'emma'")
    return r


# both sides of a merge: status and category per slug
CTES["mine"] = (
    "SELECT slug, CASE length(slug) % 4 WHEN 1 THEN 'kind' WHEN 2 THEN NULL ELSE category_slug END AS cat, "
    "CASE length(slug) % 4 WHEN 2 THEN 'archived' WHEN 1 THEN 'active' ELSE status END AS st FROM reg WHERE length(slug) % 4 <> 0"
)
CTES["judged"] = (
    "SELECT slug, CASE WHEN m.slug IS NULL THEN 'created' WHEN m.st = r.status AND m.cat IS NOT DISTINCT FROM r.category_slug THEN 'same' "
    "WHEN m.st = 'active' AND r.status = 'active' THEN 'conflict' WHEN m.st = 'archived' AND r.status = 'active' AND m.cat IS NULL THEN 'promoted' ELSE 'conflict' END AS outcome "
    "FROM (SELECT * FROM reg WHERE slug IN (SELECT resolved FROM tagrows t JOIN resolved x ON x.tag = t.tag)) r LEFT JOIN mine m USING (slug)"
)
NEEDS.update({"mine": ("reg",), "judged": ("mine", "resolved")})


@query("import_registry", sql("SELECT slug AS subject, outcome FROM judged WHERE outcome <> 'same'", "judged"))
def import_registry(spark, sf):
    """Outcome per tag when the exported part is merged into another registry."""
    side = _side_frames(spark, sf)
    own = _other_registry(spark, sf)
    _, report = rg.merge_tags(own["tags"], side["tags"], own["lifecycle"])
    return report.select("subject", "outcome")


@query("import_registry_rows", sql(
    "SELECT 'categories' AS part, count(*) AS rows FROM (SELECT 'kind' AS s UNION SELECT 'brand' UNION SELECT category_slug FROM reg WHERE category_slug IS NOT NULL AND slug IN (SELECT slug FROM used)) UNION ALL "
    "SELECT 'tags', (SELECT count(*) FROM mine) + (SELECT count(*) FROM judged WHERE outcome = 'created') UNION ALL "
    "SELECT 'characters', count(DISTINCT slug) FROM people UNION ALL SELECT 'mappings', count(*) FROM maps UNION ALL "
    "SELECT 'aliases', count(*) FROM alias UNION ALL SELECT 'system_prompts', count(DISTINCT c) FROM tsys WHERE i = 0", "judged", "mine", "people", "maps", "resolved", "alias", "tsys", used=USED))
def import_registry_rows(spark, sf):
    kept = _written_registry(spark, sf)
    side = _written_sidecar(spark, sf, kept)
    same = ad.table(spark, sf, "conversations").agg(F.lit("dataset-1").alias("dataset_uuid"))
    out, _ = rg.import_registry(_other_registry(spark, sf, kept), side, entries_uuid=same, entry_uuids=_uuids(spark, sf))
    rows = None
    out["aliases"] = out["lifecycle"].where(F.col("action").isin("rename", "merge"))
    for name in ("categories", "tags", "aliases", "characters", "system_prompts", "mappings"):
        one = out[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
        rows = one if rows is None else rows.unionByName(one)
    return rows


# --- finalization of a load -----------------------------------------------------------------------------


def _finalized(spark, sf):
    """The dirty, tagged and identified entries, finalized with the sidecar of their own dataset."""
    rows = ad.with_uuids(ad.with_part_tags(ad.entries_dirty(spark, sf), spark, sf))
    kept = _written_registry(spark, sf)
    return load.finalize_load(rows, kept, _written_sidecar(spark, sf, kept))


@query("finalize_entries", sql(
    "SELECT d.e AS entry_index, d.roles, coalesce(t.tags, '') AS tags, coalesce(t.n, 0) AS alias_rewrites, d.n AS character_turns FROM "
    "(SELECT e, string_agg(CASE WHEN r = 'Emma' THEN 'assistant' ELSE r END, ',' ORDER BY i) AS roles, count(*) FILTER (r = 'Emma') AS n FROM dirty GROUP BY e) d LEFT JOIN "
    "(SELECT t.e, string_agg(CASE WHEN r.kind = 'alias_mapped' THEN r.resolved ELSE t.tag END, ',' ORDER BY t.pos) AS tags, "
    "count(*) FILTER (r.kind = 'alias_mapped') AS n FROM tagrows t JOIN resolved r ON r.tag = t.tag GROUP BY t.e) t ON t.e = d.e", "dirty", "resolved"))
def finalize_entries(spark, sf):
    out = _finalized(spark, sf).entries
    return out.select(
        "entry_index", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.array_join("tags", ",").alias("tags"),
        "alias_rewrites", "character_turns",
    )


@query("finalize_summary", sql(
    "SELECT (SELECT count(*) FROM tagrows t JOIN resolved r ON r.tag = t.tag WHERE r.kind = 'alias_mapped') AS alias_rewrite_count, "
    "(SELECT count(DISTINCT e) FROM tagrows t JOIN resolved r ON r.tag = t.tag WHERE r.kind = 'alias_mapped') AS alias_rewritten_entries, "
    "(SELECT count(*) FROM maps) AS character_turns, (SELECT count(DISTINCT e) FROM maps) AS character_entries, "
    "(SELECT count(DISTINCT resolved) FROM resolved WHERE kind IN ('archived', 'unknown')) AS pending_trust_count, 0 AS character_candidate_count, "
    "false AS dataset_is_native, (SELECT count(*) FROM ids) AS entries_analyzed, 0 AS sidecar_conflict, 0 AS sidecar_error", "tagrows", "resolved", "maps", "ids"))
def finalize_summary(spark, sf):
    return _finalized(spark, sf).summary().select(
        "alias_rewrite_count", "alias_rewritten_entries", "character_turns", "character_entries", "pending_trust_count", "character_candidate_count",
        "dataset_is_native", "entries_analyzed", "sidecar_conflict", "sidecar_error",
    )


@query("pending_tag_positions", sql(
    "SELECT r.slug, t.e AS entry_index, CASE r.kind WHEN 'archived' THEN 'sidecar_hint' ELSE 'no_hint' END AS resolution, "
    "CASE r.kind WHEN 'archived' THEN 'archived' END AS sidecar_status FROM tagrows t JOIN resolved r ON r.tag = t.tag WHERE r.kind IN ('archived', 'unknown')", "tagrows", "resolved"))
def pending_tag_positions(spark, sf):
    """Every use of a tag that waits for trust, with what the sidecar says of it."""
    done = _finalized(spark, sf)
    return done.positions.join(done.pending, "slug").select("slug", "entry_index", "resolution", "sidecar_status")


@query("import_states", sql(
    "SELECT slug, CASE status WHEN 'active' THEN 'assign_category' ELSE 'import_archived' END AS action FROM reg JOIN judged USING (slug) WHERE outcome IN ('created', 'promoted')", "reg", "judged"))
def import_states(spark, sf):
    """The state that an import records for each tag it created or promoted."""
    side = _side_frames(spark, sf)
    own = _other_registry(spark, sf)
    _, report = rg.merge_tags(own["tags"], side["tags"], own["lifecycle"])
    return rg.imported_states(side["tags"], report).select("slug", "action")


# --- streaming --------------------------------------------------------------------------------------------


@query("stream_clean", sql(
    "SELECT count(*) AS entries, count(*) FILTER (k IN (0, 1, 2, 3, 4, 5, 6, 7, 9)) AS objects_and_values FROM kinds WHERE k <> 8", "kinds"))
def stream_clean(spark, sf):
    """Written lines through the streaming reader, all that is available."""
    stream = se.clean_stream(spark, _written_lines(spark, sf))
    out = scratch_path(spark, "stream")
    se.write_clean(stream, out, scratch_path(spark, "stream-state"))
    done = spark.read.parquet(out)
    return done.agg(F.count(F.lit(1)).alias("entries"), F.count("diagnostics").alias("objects_and_values"))


def _streamed(spark, source, step):
    """What ``step`` makes of the files of a folder, in several micro-batches."""
    out = scratch_path(spark, "stream")
    found = spark.read.format("binaryFile").load(source).count()  # names only, no content
    files_per_batch = max(1, -(-found // BATCHES))
    sb.run_stream(spark, source, out, scratch_path(spark, "stream-state"), step, files_per_batch=files_per_batch)
    return sb.results(spark, out)


@query("stream_load", sql(
    f"SELECT CASE WHEN k IN (0, 1, 2, 6, 9) THEN md5(string_agg({NORMAL_ROLE} || chr(1) || {strip('c')}, chr(2) ORDER BY i)) END AS fingerprint, "
    "max(CASE WHEN k IN (0, 1, 3, 6) THEN '' WHEN k = 2 THEN 'a,b' WHEN k = 4 THEN 'a' WHEN k = 7 THEN 's' WHEN k = 9 THEN coalesce(g.tags, '') END) AS tags "
    f"FROM dirty d JOIN kinds USING (e) LEFT JOIN (SELECT e, string_agg({slug('tag')}, ',' ORDER BY pos) AS tags FROM tagrows GROUP BY e) g ON g.e = d.e "
    "WHERE k <> 8 GROUP BY d.e, k", "dirty", "kinds", "tagrows"))
def stream_load(spark, sf):
    """All written lines through conversion and normalization, a share of the files a micro-batch."""
    out = _streamed(spark, _written_lines(spark, sf), load.entries_from_records)
    return out.select(_fingerprint().alias("fingerprint"), F.array_join("tags", ",").alias("tags"))


@query("stream_registry", sql(
    "SELECT d.roles, coalesce(t.tags, '') AS tags, coalesce(t.n, 0) AS rewrite_count FROM "
    "(SELECT e, string_agg(CASE WHEN r = 'Emma' THEN 'assistant' ELSE r END, ',' ORDER BY i) AS roles FROM dirty GROUP BY e) d LEFT JOIN "
    "(SELECT t.e, string_agg(CASE WHEN r.kind = 'alias_mapped' THEN r.resolved ELSE t.tag END, ',' ORDER BY t.pos) AS tags, "
    "count(*) FILTER (r.kind = 'alias_mapped') AS n FROM tagrows t JOIN resolved r ON r.tag = t.tag GROUP BY t.e) t ON t.e = d.e", "dirty", "resolved"))
def stream_registry(spark, sf):
    """Alias rewriting and character names on a stream of the dirty entries."""
    path = scratch_path(spark, "lines")
    files.write_jsonl(ad.with_part_tags(ad.entries_dirty(spark, sf), spark, sf), path)
    # the registry stands still: read and walked once, not in every micro-batch
    kept = registry(spark, sf)
    roles = cut_lineage(ch.known_character_roles(kept["characters"], kept["mappings"]))
    tags, cats, life = (cut_lineage(kept[k]) for k in ("tags", "categories", "lifecycle"))
    targets = tg.alias_targets(life, tg.active_tags(tags, cats).select("slug"))

    def step(records):
        rows = en.parse_entries(records)
        resolved = tg.resolve_tags(tg.raw_tags(rows), tags, cats, life, targets)
        return ch.normalize_character_roles(tg.canonicalize_aliases(rows, resolved), roles)[0]

    out = _streamed(spark, path, step)
    return out.select(F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.array_join("tags", ",").alias("tags"), "rewrite_count")
