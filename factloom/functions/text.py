"""Column expressions over text: folding, tokens, word sets, LIKE folding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Combining marks that the index tokenizer drops inside a token.
DROPPED_MARKS = (
    "̀́̂̃̄̆̇̈̉̊̋̌̏"
    "̧̨̛̣̤̥̦̭̮̰̱̑"
)

# Letters folded to another letter without being base + one mark.
OTHER_FOLDS = {"ſ": "s", "ẛ": "s", "ς": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε"}

# Words ignored when summaries are compared. Only tokens that the
# word pattern can produce are listed; hyphenated names can never match it.
IGNORED_WORDS = (
    "cz", "sk", "pl", "ro", "it", "hu", "en",
    "czech", "slovak", "polish", "romanian", "italian", "hungarian",
)

TOKEN_PATTERN = r"[\p{L}\p{N}\p{Co}]+"
# The same in a text that is not folded, where dropped marks stand inside a token.
UNFOLDED_TOKEN_PATTERN = rf"[\p{{L}}\p{{N}}\p{{Co}}][\p{{L}}\p{{N}}\p{{Co}}{DROPPED_MARKS}]*"
WORD_PATTERN = "[a-z0-9_]+"


def _latin_folds() -> dict[str, str]:
    """Lower-case Latin letters made of an ASCII letter and exactly one mark."""
    folds = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if letter == letter.lower() and len(parts) == 2 and parts[0].isascii():
            folds[letter] = parts[0]
    return folds


_FOLDS = {**_latin_folds(), **OTHER_FOLDS}
FOLD_FROM = "".join(_FOLDS) + DROPPED_MARKS
FOLD_TO = "".join(_FOLDS.values())
_FOLD_TABLE = str.maketrans(FOLD_FROM[: len(FOLD_TO)], FOLD_TO, DROPPED_MARKS)


def fold(text: Column) -> Column:
    """Lower-case and strip single diacritics from Latin letters."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """Index tokens of a text, in order: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(text: Column) -> Column:
    """How many index tokens a text has; folding changes none into another number."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(UNFOLDED_TOKEN_PATTERN))


def query_tokens(word: str) -> list[str]:
    """The same tokens for one query word, on the driver."""
    out, run = [], []
    for ch in word.lower().translate(_FOLD_TABLE) + " ":
        category = unicodedata.category(ch)
        if category[0] in "LN" or category == "Co":
            run.append(ch)
        elif run:
            out.append("".join(run))
            run = []
    return out


def word_set(text: Column, ignored: tuple[str, ...] = IGNORED_WORDS) -> Column:
    """Distinct lower-case ASCII words minus the ignored ones, sorted."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))
    stop = F.array(*[F.lit(w) for w in ignored]) if ignored else F.array().cast("array<string>")
    return F.sort_array(F.array_except(words, stop))


# The two wildcards of LIKE, as regular expressions.
LIKE_WILDCARDS = {"%": ".*", "_": "."}


def _folded_pattern(term: str, wildcards: dict[str, str]) -> str:
    """A Java pattern found where the term is; its (?i) folds ASCII letters only, (?s) lets a dot span lines."""
    return "(?is)" + "".join(
        wildcards.get(ch) or (ch if ch.isalnum() or not ch.isascii() else "\\" + ch) for ch in term
    )


def like_contains(text: Column, term: str) -> Column:
    """``text LIKE '%term%'`` with live wildcards, no escape character, ASCII case folding."""
    return text.rlike(_folded_pattern(term.strip("%"), LIKE_WILDCARDS))


def like_pattern(term: Column) -> Column:
    """The same pattern for a column of terms (without wildcards at their ends), for ``rlike``."""
    signs = F.regexp_replace(term, r"([\x00-\x7f&&[^a-zA-Z0-9%_]])", r"\\$1")
    return F.concat(F.lit("(?is)"), F.replace(F.replace(signs, F.lit("%"), F.lit(".*")), F.lit("_"), F.lit(".")))


def folded_contains(text: Column, term: str) -> Column:
    """The term itself anywhere in the text, ASCII case folding."""
    return text.rlike(_folded_pattern(term, {})) if term else text.isNotNull()


def component_stem(component: str) -> str:
    """Text before the last dot anywhere; empty for a leading-dot name."""
    return component.rpartition(".")[0] if "." in component else component


def component_stem_col(component: Column) -> Column:
    return F.when(F.instr(component, ".") > 0, F.regexp_replace(component, r"\.[^.]*$", "")).otherwise(component)


def split_clean(text: str, separator: str) -> list[str]:
    """Split, trim, drop blanks."""
    return [part.strip() for part in text.split(separator) if part.strip()]


def json_list(text: Column) -> Column:
    """A JSON list in text as an array; null or empty text gives an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def clamp(value: float, low: float, high: float) -> float:
    return max(low, min(value, high))
