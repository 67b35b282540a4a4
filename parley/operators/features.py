"""One small row of measurements per entry; every report reads these.

Two front ends give the same rows. ``from_entries`` works inside the nested
row and needs no shuffle. ``from_turns`` starts from one row per turn and is a
plain partial aggregate of numbers, so neither the text nor an arbitrarily
long conversation is ever gathered in one place.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.constants import PLACEHOLDER_PHRASES
from . import entries as en

SHORT_WORDS = 20
FEATURES = (
    "entry_index", "n_messages", "exchanges", "user_n", "user_chars",
    "user_words", "asst_n", "asst_chars", "asst_words", "asst_min_chars",
    "asst_max_chars", "text_chars", "short_n", "empty_n", "placeholder_n",
    "prompt_key", "prompt_chars",
)


def placeholder_form(form: Column, words: Column) -> Column:
    """Placeholder test on text that is already in comparison form."""
    return (form != "") & ((words == 1) | tx.contains_any(form, PLACEHOLDER_PHRASES))


def is_placeholder(content: Column, words: Column) -> Column:
    return tx.bind(tx.search_form(content), lambda form: placeholder_form(form, words))


def prompt_key(prompt: Column) -> Column:
    """Hash of a normalized prompt, NULL when it is blank."""
    form = tx.search_form(prompt)
    return F.when(form != "", F.sha1(form))


def short_key(key) -> Column:
    """The part of a prompt's hash that is shown."""
    return F.substring(key, 1, 12)


def from_turns(turns: DataFrame) -> DataFrame:
    """Features from ``(entry_index, turn_index, role, content)`` rows."""
    role, content = F.col("role"), F.coalesce(F.col("content"), F.lit(""))
    answer, question = role.eqNullSafe("assistant"), role.eqNullSafe("user")
    per_turn = turns.select(
        "entry_index",
        "role",
        F.length(content).alias("chars"),
        F.when(answer | question, tx.word_count(content)).alias("words"),
        answer.alias("answer"),
        question.alias("question"),
        F.when(answer, content).alias("answer_text"),
        F.when((F.col("turn_index") == 0) & (role == "system"), content).alias("prompt"),
    ).select(
        "*",
        (F.col("answer") & is_placeholder(F.col("answer_text"), F.col("words"))).alias("placeholder"),
        prompt_key(F.col("prompt")).alias("key"),
        F.length(tx.strip(F.col("prompt"))).alias("prompt_len"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = lambda cond, c: zero(F.sum(F.when(cond, c)))
    a, q = F.col("answer"), F.col("question")
    return per_turn.groupBy("entry_index").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.floor(F.count_if(~F.col("role").eqNullSafe("system")) / 2).cast("int").alias("exchanges"),
        F.count_if(q).alias("user_n"),
        total(q, F.col("chars")).alias("user_chars"),
        total(q, F.col("words")).alias("user_words"),
        F.count_if(a).alias("asst_n"),
        total(a, F.col("chars")).alias("asst_chars"),
        total(a, F.col("words")).alias("asst_words"),
        F.min(F.when(a, F.col("chars"))).alias("asst_min_chars"),
        F.max(F.when(a, F.col("chars"))).alias("asst_max_chars"),
        zero(F.sum("chars")).alias("text_chars"),
        F.count_if(a & (F.col("words") < SHORT_WORDS)).alias("short_n"),
        F.count_if(a & (F.col("words") == 0)).alias("empty_n"),
        F.count_if(F.col("placeholder")).alias("placeholder_n"),
        F.max("key").alias("prompt_key"),
        F.coalesce(F.max("prompt_len"), F.lit(0)).alias("prompt_chars"),
    )


def from_entries(entries: DataFrame) -> DataFrame:
    """The same features from nested entries, plus id, tags and stamps."""
    def sized(role):
        noted = F.transform(
            en.role_contents(role),
            lambda c: F.struct(
                F.length(c).alias("chars"), tx.word_count(c).alias("words"), tx.search_form(c).alias("form")
            ),
        )
        if role == "user":
            return F.transform(noted, lambda x: F.struct(x["chars"].alias("chars"), x["words"].alias("words")))
        return F.transform(
            noted,
            lambda x: F.struct(
                x["chars"].alias("chars"), x["words"].alias("words"),
                placeholder_form(x["form"], x["words"]).alias("placeholder"),
            ),
        )

    rows = en.once(entries, u=sized("user"), a=sized("assistant")).select(
        "entry_index",
        en.entry_id().alias("entry_id"),
        F.size(en.messages_or_empty()).cast("long").alias("n_messages"),
        en.exchanges().alias("exchanges"),
        "u",
        "a",
        en.text_length().alias("text_chars"),
        en.system_prompt().alias("prompt"),
        en.clean_tags().alias("tags"),
        F.col("meta.native").alias("native"),
        en.entry_uuid().alias("entry_uuid"),
        F.when(F.col("meta.dataset_uuid") != "", F.col("meta.dataset_uuid")).alias("dataset_uuid"),
    )
    total = lambda arr, field: F.aggregate(
        arr, F.lit(0).cast("long"), lambda acc, x: acc + x[field]
    )
    number = lambda arr, cond: F.size(F.filter(arr, cond)).cast("long")
    return rows.select(
        "entry_index",
        "n_messages",
        "exchanges",
        F.size("u").cast("long").alias("user_n"),
        total("u", "chars").alias("user_chars"),
        total("u", "words").alias("user_words"),
        F.size("a").cast("long").alias("asst_n"),
        total("a", "chars").alias("asst_chars"),
        total("a", "words").alias("asst_words"),
        F.array_min(F.transform("a", lambda x: x["chars"])).alias("asst_min_chars"),
        F.array_max(F.transform("a", lambda x: x["chars"])).alias("asst_max_chars"),
        "text_chars",
        number("a", lambda x: x["words"] < SHORT_WORDS).alias("short_n"),
        number("a", lambda x: x["words"] == 0).alias("empty_n"),
        number("a", lambda x: x["placeholder"]).alias("placeholder_n"),
        prompt_key(F.col("prompt")).alias("prompt_key"),
        F.length(tx.strip(F.col("prompt"))).alias("prompt_chars"),
        "entry_id",
        "tags",
        "native",
        "entry_uuid",
        "dataset_uuid",
        F.transform("a", lambda x: x["words"]).alias("answer_words"),
    )


def answer_words_from_turns(turns: DataFrame) -> DataFrame:
    """Word count of every assistant message, one row each."""
    return turns.where(F.col("role") == "assistant").select(
        tx.word_count(F.col("content")).alias("words")
    )


def answer_words_from_features(features: DataFrame) -> DataFrame:
    return features.select(F.explode("answer_words").alias("words"))
