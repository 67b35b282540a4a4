"""Fixed values the results depend on, stated as plain text."""

# --- fixed values: characters that count as white space -------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORD_PATTERN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"

# --- fixed values: role spellings ------------------------------------------
USER_SPELLINGS = (
    "user", "usr", "uesr", "useer", "human", "humans", "person", "player",
    "input", "prompt", "instruction",
)
ASSISTANT_SPELLINGS = (
    "assistant", "assistnt", "assitant", "assitstant", "asistant", "asst",
    "bot", "chatbot", "gpt", "model", "ai", "completion", "response", "output",
)
SYSTEM_SPELLINGS = (
    "system", "sys", "sytem", "systm", "system_prompt", "context",
)

# --- fixed values: phrases ---------------------------------------------------
REFUSAL_PHRASES = (
    "as an ai language model",
    "i cannot assist",
    "i'm just a language model",
    "i don't have personal",
    "i'm not able to",
    "as an artificial intelligence",
    "i must remind you that",
    "it's important to note that i",
)
PLACEHOLDER_PHRASES = (
    "test", "testing", "asdf", "placeholder", "todo", "tbd", "lorem ipsum",
    "[insert", "<insert", "n/a",
)

# --- fixed values: patterns --------------------------------------------------
BOLD_PATTERN = r"\*\*[^*\n][\s\S]*?[^*\n]\*\*"
HEADING_PATTERN = r"(?m)^\s{0,3}#{1,6}\s+\S"
JSON_FRAGMENT_PATTERN = r'\{\s*"[^"]+"\s*:'
QUOTE_PATTERN = r'(?:\\"|")([^"\\]*+(?:\\.[^"\\]*+)*)(?:\\"|")'

# --- fixed values: record formats --------------------------------------------
CHATML, SHAREGPT, UNKNOWN = "chatml", "sharegpt", "unknown"
SHAREGPT_ROLE_KEYS = ("from", "role", "speaker")
SHAREGPT_CONTENT_KEYS = ("value", "content", "text")
SHAREGPT_ROLE_OF = {"user": "human", "assistant": "gpt", "system": "system"}
TRAINING_OBJECT_KEYS = ("messages", "conversations", "instruction", "output")
DATASET_EXTENSIONS = (".jsonl", ".json", ".txt")
META_KEY = "_entry_meta"
KNOWN_KEYS = ("messages", "conversations", "tags", "metadata", "source", "id")
SHAREGPT_KNOWN_KEYS = KNOWN_KEYS + ("conversation", "title", "model")
IMPORT_SYSTEM_PROMPT = (
    "Imported from a ShareGPT record. This prompt is internal and is left out "
    "of ShareGPT exports."
)

# --- fixed values: diagnostics --------------------------------------------------
AUTOMATIC_CODES = (
    "base.missing_tags", "base.tags_not_list", "base.invalid_tag_value",
    "base.empty_tag", "chatml.role_canonicalization",
    "chatml.content_whitespace", "sharegpt.role_variant",
)
TAG_CODES = (
    "base.missing_tags", "base.tags_not_list", "base.invalid_tag_value",
    "base.empty_tag",
)
STRUCTURE_FLAG_CODES = (
    "chatml.duplicate_system_message", "chatml.ai_refusal_language",
    "chatml.split_candidate", "chatml.formatting_leakage",
)

# --- fixed values: default tag taxonomy -----------------------------------------
TAXONOMY = {
    "Behavior": (
        "pacing", "boundaries", "no_user_control", "followup_question",
        "emotional_awareness", "instruction_following", "consistency",
        "initiative",
    ),
    "Interaction": (
        "greeting", "roleplay", "question_answer", "task_completion",
        "explanation", "feedback", "correction",
    ),
    "Style": (
        "dialogue", "narration", "descriptive", "concise", "detailed",
        "grounded",
    ),
    "Source": ("manual", "ai_generated", "imported", "converted"),
    "Status": (
        "draft", "needs_review", "needs_edit", "approved", "invalid",
        "duplicate",
    ),
}
UPPERCASE_TAG_WORDS = ("ai", "id", "llm", "rp")
UNTAGGED = "__untagged__"

# --- fixed values: tag lifecycle vocabulary ---------------------------------------
ALIAS_ACTIONS = ("rename", "merge")
RETIRED_ACTIONS = ("archive", "hide", "delete")
CURRENT_ACTIONS = (
    "import_archived", "import_uncategorized", "archive", "restore",
    "assign_category", "hide", "delete",
)
