"""The text and role expressions as SQL snippets.

The validators are large trees of small expressions; written as SQL they are
parsed once in the JVM instead of being assembled call by call from Python.
"""

from .constants import (
    ASSISTANT_SPELLINGS,
    SHAREGPT_ROLE_OF,
    SYSTEM_SPELLINGS,
    USER_SPELLINGS,
    WHITESPACE,
    WORD_PATTERN,
)


def lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(words) -> str:
    return ", ".join(lit(w) for w in words)


WHITESPACE_LITERAL = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "'"


def strip(x: str) -> str:
    return f"btrim({x}, {WHITESPACE_LITERAL})"


def is_blank(x: str) -> str:
    return f"coalesce({strip(x)}, '') = ''"


def casefold(x: str) -> str:
    out = f"translate(lower({x}), 'ςſ', 'σs')"
    for src, dst in (
        ("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"),
        ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"),
    ):
        out = f"replace({out}, '{src}', '{dst}')"
    return out


_SPELLINGS = {
    "user": USER_SPELLINGS, "assistant": ASSISTANT_SPELLINGS, "system": SYSTEM_SPELLINGS,
}


def _spelling_map(names: dict) -> str:
    pairs = [f"{lit(word)}, {lit(names[role])}" for role, words in _SPELLINGS.items() for word in words]
    return f"map({', '.join(pairs)})"


ROLE_MAP = _spelling_map({role: role for role in _SPELLINGS})
SHAREGPT_MAP = _spelling_map(SHAREGPT_ROLE_OF)


def standard_role(x: str) -> str:
    return f"try_element_at({ROLE_MAP}, lower({strip(x)}))"


def sharegpt_role(std: str) -> str:
    """ShareGPT name of a standard role."""
    return f"CASE {std} WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' WHEN 'system' THEN 'system' END"


def expected_role(i: str) -> str:
    return f"CASE WHEN {i} = 0 THEN 'system' WHEN {i} % 2 = 1 THEN 'user' ELSE 'assistant' END"


def contains_any(x: str, phrases) -> str:
    return f"exists(array({_list(phrases)}), p -> contains({x}, p))"


def word_count(x: str) -> str:
    return f"regexp_count(coalesce({x}, ''), {lit(WORD_PATTERN)})"
