"""Load a dataset: read, convert, normalize, diagnose, finalize."""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import characters as ch
from ..operators import entries as en
from ..operators import formats as fo
from ..operators import mutate as mu
from ..operators import normalize as no
from ..operators import registry as rg
from ..operators import tags as tg
from ..operators import validate as va
from ..session import cut_lineage
from ..sources import files


def entries_from_records(records: DataFrame, *, auto_normalize: bool = True) -> DataFrame:
    """Records to clean entries with their counters.

    Columns beyond the entry: ``converted``, ``warnings``, ``changed`` (by any
    step after conversion) and the step counters. One projection after the
    format vote.
    """
    converted = fo.convert_to_chatml(records)
    base = no.normalize_baseline(converted).withColumnsRenamed(
        {
            "changed": "base_changed", "roles_normalized": "base_roles", "contents_trimmed": "base_trimmed",
        }
    )
    if not auto_normalize:
        return base.withColumn("changed", F.col("base_changed"))
    full = no.normalize_entries(base)
    return (
        full.withColumn("changed", F.col("changed") | F.col("base_changed"))
        .withColumn("roles_normalized", F.col("roles_normalized") + F.col("base_roles"))
        .withColumn("contents_trimmed", F.col("contents_trimmed") + F.col("base_trimmed"))
        .drop("base_roles", "base_trimmed")
    )


def load_dataset(spark: SparkSession, path: str, *, layout: str = "auto", auto_normalize: bool = True):
    """``(entries, parsed)`` of the dataset files under a path.

    ``parsed`` keeps one row per line with its error, for counts and reports.
    """
    parsed = files.read_dataset(spark, path, layout=layout)
    return entries_from_records(files.index_records(parsed), auto_normalize=auto_normalize), parsed


def load_summary(entries: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row with every counter of a load."""
    analyzed = va.analyze_chatml(entries.select(*en.ENTRY_COLUMNS))
    diagnostics = va.diagnostic_summary(analyzed, tag_faults_block=False)
    counts = parsed.agg(
        F.count(F.lit(1)).alias("source_line_count"),
        F.count("record").alias("parsed_entry_count"),
        F.count("error").alias("parse_error_count"),
    )
    no_text_tag = ~F.exists(F.coalesce("tags", en.empty_strings()), lambda t: F.coalesce(F.trim(t) != "", F.lit(False)))
    steps = entries.agg(
        F.count_if("changed").alias("changed_entries"),
        F.count_if("converted").alias("converted_entries"),
        F.coalesce(F.sum("roles_normalized"), F.lit(0)).alias("roles_normalized"),
        F.coalesce(F.sum("contents_trimmed"), F.lit(0)).alias("contents_trimmed"),
        F.count_if("structural_changed").alias("structural_changed_entries"),
        F.coalesce(F.sum(F.size("dropped_tags")), F.lit(0)).alias("dropped_tags"),
        F.count_if(no_text_tag).alias("untagged_entries"),
    )
    return counts.crossJoin(steps).crossJoin(diagnostics)


def finalize(entries: DataFrame, registry: dict):
    """The registry steps of a load, in their order.

    Identities, alias rewriting, known character names, mapping upsert and tag
    adoption. The registry must already hold an imported sidecar, as that can
    add aliases. Returns ``(entries, registry)``; entries are written once to
    the shared folder after the identities, since later steps read them again.
    """
    rows = cut_lineage(no.ensure_entry_uuid(entries.select(*en.ENTRY_COLUMNS)))
    resolved = tg.resolve_tags(tg.raw_tags(rows), registry["tags"], registry["categories"], registry["lifecycle"])
    rows = tg.canonicalize_aliases(rows, resolved).drop("rewrite_count")
    rows, found = ch.normalize_known_characters(rows, registry["characters"], registry["mappings"])
    out = dict(registry)
    out["mappings"] = ch.upsert_mappings(registry["mappings"], found, registry["characters"])
    out["tags"], out["lifecycle"], _ = tg.adopt_unknown_tags(
        rows, registry["tags"], registry["categories"], registry["lifecycle"]
    )
    return rows, out


class Finalized(NamedTuple):
    """What a load leaves for review, next to its entries and the registry."""

    entries: DataFrame  # with ``alias_rewrites`` and ``character_turns``, the changes of each
    registry: dict
    sidecar_report: DataFrame | None  # outcome of every item of an imported sidecar
    candidates: DataFrame  # custom roles that are still there
    pending: DataFrame  # imported tags to be trusted, with the sidecar's hint
    positions: DataFrame  # the same tags with the entries that use them
    analyzed: DataFrame  # the finished entries with their diagnostics

    def summary(self) -> DataFrame:
        """One row with every counter of the finalization."""
        turned = F.col("character_turns") > 0
        steps = self.entries.agg(
            F.coalesce(F.sum("alias_rewrites"), F.lit(0)).alias("alias_rewrite_count"),
            F.count_if(F.col("alias_rewrites") > 0).alias("alias_rewritten_entries"),
            F.coalesce(F.sum("character_turns"), F.lit(0)).alias("character_turns"), F.count_if(turned).alias("character_entries"),
            F.count_if((F.col("alias_rewrites") > 0) | turned).alias("finalized_entries"),
        )
        parts = [
            self.pending.agg(F.count(F.lit(1)).alias("pending_trust_count")),
            self.candidates.agg(F.count(F.lit(1)).alias("character_candidate_count")),
            no.is_native_dataset(self.entries).withColumnRenamed("is_native", "dataset_is_native"),
            va.diagnostic_summary(self.analyzed, tag_faults_block=False),
        ]
        if self.sidecar_report is not None:
            outcomes = ("created", "promoted", "conflict", "warning", "error")
            parts.append(self.sidecar_report.agg(*[F.count_if(F.col("outcome") == o).alias(f"sidecar_{o}") for o in outcomes]))
        for part in parts:
            steps = steps.crossJoin(part)  # one row each
        return steps


def finalize_load(entries: DataFrame, registry: dict, sidecar: dict | None = None) -> Finalized:
    """The whole finalization of a load, in its order.

    Identities; the sidecar's frames behind the check of the dataset's id; alias
    rewriting; known character names and their mappings; custom roles that are left;
    adoption of unknown tags; tags to be trusted. Diagnostics are those of the
    finished entries: the projection costs less than finding out which of them changed.
    """
    rows = cut_lineage(no.ensure_entry_uuid(entries.select(*en.ENTRY_COLUMNS)))
    out, report = dict(registry), None
    if sidecar is not None:
        out, report = rg.import_registry(
            registry, sidecar, entries_uuid=no.dataset_uuid(rows), entry_uuids=rows.select(en.entry_uuid().alias("entry_uuid"))
        )
        out = dict(registry) | {k: cut_lineage(v) for k, v in out.items()}
    resolved = cut_lineage(tg.resolve_tags(tg.raw_tags(rows), out["tags"], out["categories"], out["lifecycle"]))
    rows = tg.canonicalize_aliases(rows, resolved).withColumnRenamed("rewrite_count", "alias_rewrites")
    rows, found = ch.normalize_known_characters(rows, out["characters"], out["mappings"])
    found = cut_lineage(found)
    turns = found.groupBy(F.col("entry_uuid").alias("_uuid")).agg(F.count(F.lit(1)).alias("_turns"))
    rows = cut_lineage(
        rows.join(turns, en.entry_uuid() == F.col("_uuid"), "left")
        .withColumn("character_turns", F.coalesce("_turns", F.lit(0))).drop("_uuid", "_turns")
    )
    out["mappings"] = ch.upsert_mappings(out["mappings"], found, out["characters"])
    out["tags"], out["lifecycle"], _ = tg.adopt_unknown_tags(rows, out["tags"], out["categories"], out["lifecycle"])
    nothing = {k: out[k].where("false") for k in ("tags", "categories")}
    return Finalized(
        rows, out, report, ch.character_candidates(rows), tg.pending_tag_trust(rows, out["tags"], out["lifecycle"], sidecar or nothing),
        tg.pending_tag_positions(rows, out["tags"], out["lifecycle"]), va.analyze_chatml(rows.select(*en.ENTRY_COLUMNS)),
    )


def save_repaired(entries: DataFrame, resolved: DataFrame, *, only=va.AUTOMATIC_CODES) -> DataFrame:
    """Automatic repairs as they are saved: repaired entries also get positional
    roles and current tag slugs, all others stay as they are. Adds ``changed``."""
    rows = va.repair_chatml(entries.select(*en.ENTRY_COLUMNS), only)
    done = F.col("changed")
    rows = rows.withColumn("messages", F.when(done, no.positional_messages(F.col("messages"))).otherwise(F.col("messages")))
    named = tg.canonicalize_aliases(rows.withColumn("_tags", F.col("tags")), resolved)
    return named.withColumn("tags", F.when(done, F.col("tags")).otherwise(F.col("_tags"))).drop("_tags", "rewrite_count")


def save_merged(frames, registry: dict, dataset: str):
    """Datasets in the given order as one saved dataset.

    First occurrences in one dense order, normalized, identified, with current
    tag slugs and stamped with the new dataset's identity. Returns ``(entries,
    kept mappings, ids whose mappings were dropped)``.
    """
    merged = mu.merge_datasets(frames).select(*en.ENTRY_COLUMNS)
    rows = cut_lineage(no.ensure_entry_uuid(no.normalize_entries(merged).select(*en.ENTRY_COLUMNS)))
    resolved = tg.resolve_tags(tg.raw_tags(rows), registry["tags"], registry["categories"], registry["lifecycle"])
    stamped = no.stamp_entries(tg.canonicalize_aliases(rows, resolved).drop("rewrite_count"), dataset=dataset)
    kept, dropped = ch.surviving_mappings(registry["mappings"], stamped)
    return stamped, kept, dropped
