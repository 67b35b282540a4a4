"""Search, tag filters, id lookup and paging over entries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.constants import UNTAGGED
from .entries import clean_tags, entry_id, entry_uuid, messages_or_empty
from .ordering import dense_index

SCOPES = ("system", "user", "assistant")
DEFAULT_SCOPES = ("user", "assistant")
DEFAULT_PAGE_SIZE = 25
BLOCKING_CODES = (
    "base.missing_tags", "base.not_dict", "chatml.empty_system_content",
    "chatml.insufficient_messages", "chatml.missing_system_role",
    "chatml.missing_messages", "chatml.messages_not_list",
    "chatml.system_not_dict",
)


def _fold(text: str) -> str:
    return " ".join(text.casefold().split())


def search_text(scopes=DEFAULT_SCOPES) -> Column:
    """Newline-joined content of the scoped roles in comparison form."""
    picked = F.filter(
        messages_or_empty(),
        lambda m: m["is_obj"]
        & m["content"].isNotNull()
        & F.coalesce(tx.casefold(tx.strip(m["role"])).isin(*scopes), F.lit(False)),
    )
    joined = F.array_join(F.transform(picked, lambda m: m["content"]), "\n")
    return tx.search_form(joined)


def matches_search(query: str, mode: str = "contains", scopes=DEFAULT_SCOPES) -> Column:
    """Predicate for one query; the query is folded once while planning."""
    folded = _fold(query)
    if not folded:
        return F.lit(True)
    valid = tuple(dict.fromkeys(s.strip().casefold() for s in scopes if s.strip().casefold() in SCOPES))
    if not valid:
        return F.lit(False)
    text = search_text(valid)
    if mode in ("contains", "exact_phrase"):
        return F.contains(text, F.lit(folded))
    if mode == "all_words":
        needed = F.array(*[F.lit(w) for w in folded.split(" ")])
        return tx.bind(text, lambda t: F.forall(needed, lambda w: F.contains(t, w)))
    raise ValueError(f"unknown search mode: {mode}")


def search(entries: DataFrame, query: str, mode: str = "contains", scopes=DEFAULT_SCOPES) -> DataFrame:
    return entries.where(matches_search(query, mode, scopes))


def matches_tags(selected, mode: str = "any") -> Column:
    """Tag predicate: any / all / exact, with the pseudo tag for untagged rows.

    An untagged row passes when the pseudo tag is selected alone, or is part of
    an exact selection; a tagged row looks at the real tags only.
    """
    if not selected:
        return F.lit(True)
    real = [t for t in dict.fromkeys(selected) if t != UNTAGGED]
    with_untagged = UNTAGGED in selected
    tags = clean_tags()
    untagged_ok = with_untagged and (not real or mode == "exact")
    if not real:
        tagged_ok = F.lit(False)
    else:
        wanted = F.array(*[F.lit(t) for t in real])
        covers = F.size(F.array_except(wanted, tags)) == 0
        if mode == "any":
            tagged_ok = F.arrays_overlap(tags, wanted)
        elif mode == "all":
            tagged_ok = covers
        elif mode == "exact":
            tagged_ok = covers & (F.size(F.array_except(tags, wanted)) == 0)
        else:
            raise ValueError(f"unknown tag mode: {mode}")
    return F.when(F.size(tags) == 0, F.lit(untagged_ok)).otherwise(tagged_ok)


def filter_tags(entries: DataFrame, selected, mode: str = "any") -> DataFrame:
    return entries.where(matches_tags(selected, mode))


def filter_entries(entries: DataFrame, *, tags=(), tag_mode="any", query="", search_mode="contains",
                   scopes=DEFAULT_SCOPES, ids: DataFrame | None = None) -> DataFrame:
    """Tags, then text, then the id set; cheap tests come first.

    ``ids`` is a frame with an ``entry_id`` column and may be as large as the
    dataset: it is a left-semi join whose strategy the optimizer picks.
    """
    out = entries.where(matches_tags(tags, tag_mode)).where(matches_search(query, search_mode, scopes))
    if ids is not None:
        out = out.withColumn("entry_id", entry_id()).join(ids.select("entry_id"), "entry_id", "left_semi")
        out = out.drop("entry_id")
    return out


def used_tags(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode(clean_tags()).alias("tag")).distinct()


def untagged_entries(entries: DataFrame) -> DataFrame:
    return entries.where(F.size(clean_tags()) == 0)


def available_filter_tags(entries: DataFrame, known: DataFrame, *, only_used: bool = True) -> DataFrame:
    """Filter options in order ``(grp, pos, tag)``: known tags in registry order,
    unknown used ones by name, then the untagged option.

    ``known`` has ``tag`` and ``rank``.
    """
    ranked = known.select("tag", "rank")
    if only_used:
        options = used_tags(entries).join(ranked, "tag", "left").select(
            F.when(F.col("rank").isNull(), 1).otherwise(0).alias("grp"),
            F.coalesce("rank", F.lit(0)).cast("long").alias("pos"),
            "tag",
        )
        pseudo = entries.agg(F.bool_or(F.size(clean_tags()) == 0).alias("any_untagged")).where(
            "any_untagged"
        )
    else:
        options = ranked.select(F.lit(0).alias("grp"), F.col("rank").cast("long").alias("pos"), "tag")
        pseudo = entries.sparkSession.range(1)
    tail = pseudo.select(F.lit(2).alias("grp"), F.lit(0).cast("long").alias("pos"), F.lit(UNTAGGED).alias("tag"))
    return options.unionByName(tail)


def lookup_by_uuid(entries: DataFrame, ids) -> DataFrame:
    """Rows for stored ids; of duplicates the last one wins.

    ``ids`` is a list of literals or a frame with ``entry_uuid``.
    """
    keyed = entries.withColumn("_uuid", entry_uuid())
    if isinstance(ids, DataFrame):
        hit = keyed.join(ids.select(F.col("entry_uuid").alias("_uuid")), "_uuid", "left_semi")
    else:
        hit = keyed.where(F.col("_uuid").isin(*ids))
    # only positions are aggregated; the wide rows are fetched by a second join
    last = hit.groupBy("_uuid").agg(F.max("entry_index").alias("entry_index"))
    return hit.join(last.select("_uuid", "entry_index"), ["_uuid", "entry_index"], "left_semi").drop("_uuid")


def page(entries: DataFrame, number: int, size: int = DEFAULT_PAGE_SIZE, *, show_all: bool = False) -> DataFrame:
    """One page in dataset order; a page past the end is the last one.

    Positions come from per-bucket counts, so a deep page costs the same as the
    first one and no task sees more rows than its bucket.
    """
    indexed = dense_index(entries, "entry_index", name="position")
    if show_all:
        return indexed
    total = entries.agg(F.count(F.lit(1)).alias("_n"))
    last = F.greatest(F.ceil(F.col("_n") / size) - 1, F.lit(0))
    wanted = F.least(F.greatest(F.lit(number), F.lit(0)), last)
    return (
        indexed.crossJoin(F.broadcast(total))
        .where(F.floor(F.col("position") / size) == wanted)
        .drop("_n")
    )


def needs_full_edit() -> Column:
    """On analyzed entries: a blocking diagnostic or no messages at all."""
    found = F.transform("diagnostics", lambda d: d["code"])
    return F.arrays_overlap(found, F.array(*[F.lit(c) for c in BLOCKING_CODES])) | (
        F.size(messages_or_empty()) == 0
    )


def has_automatic_issue() -> Column:
    return F.exists("diagnostics", lambda d: d["repair_kind"] == "automatic")
