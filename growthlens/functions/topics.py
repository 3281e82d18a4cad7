"""Topics packed in a text, as the reference pipeline reads them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from growthlens.functions.values import strip

#: Topic flags and the texts that set them, anywhere in the lower-cased topics (fixed values).
TOPIC_KEYWORDS = {
    "has_ai_topic": ["ai", "artificial-intelligence"],
    "has_ml_topic": ["machine-learning", "ml"],
    "has_deep_learning_topic": ["deep-learning", "neural-network"],
    "has_data_science_topic": ["data-science", "data-analysis"],
    "has_web_topic": ["web", "react", "javascript", "frontend", "backend"],
    "has_llm_topic": ["llm", "large-language-model", "generative-ai"],
}


#: A text literal: prefix, then single, double or tripled quotes with escapes. Loops are possessive: they need no stack for long texts.
TEXT = r"""(?:[uUrR]?(?:\'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}|"{3}(?:[^"\\]|\\.|"(?!""))*+"{3}|'(?!'')(?:[^'\\\n]|\\.)*+'|"(?!"")(?:[^"\\\n]|\\.)*+"))"""
#: An element of a list literal: adjacent texts, which are one, or a number or constant.
ELEMENT = rf"(?:{TEXT}(?:\s*+{TEXT})*+|[+-]?\d[\d_]*+(?:\.\d*+)?(?:[eE][+-]?\d++)?|None|True|False)"
LIST = rf"(?s)^\[\s*+(?:{ELEMENT}(?:\s*+,\s*+{ELEMENT})*+\s*+,?+\s*+)?+\]$"


def as_list(text: Column) -> Column:
    """Elements, as texts, of a list literal such as ``['a', "b",]``; null for anything else.

    Understood are texts with their quotes, escapes, prefixes and adjacent parts, numbers and
    constants; lists within lists are not, and count as no literal.
    """
    trimmed = strip(text)

    def body(literal: Column) -> Column:
        """What a text literal says."""
        raw = F.regexp_like(literal, F.lit("^[rR]"))
        quoted = F.regexp_replace(literal, "^[uUrR]", "")
        inner = F.regexp_replace(quoted, r"(?s)^(?:\'{3}|\"{3}|'|\")(.*?)(?:\'{3}|\"{3}|'|\")$", "$1")
        plain = inner
        for escape, meaning in ((r"\\\n", ""), (r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\r"), (r"\\(['\"])", "$1"), (r"\\\\", r"\\")):
            plain = F.regexp_replace(plain, escape, meaning)
        return F.when(raw, inner).otherwise(plain)

    def said(element: Column) -> Column:
        texts = F.regexp_extract_all(element, F.lit("(?s)" + TEXT), F.lit(0))
        return F.when(F.regexp_like(element, F.lit("""^[uUrR]?['"]""")), F.array_join(F.transform(texts, body), "")).otherwise(element)

    return F.when(F.regexp_like(trimmed, F.lit(LIST)), F.transform(F.regexp_extract_all(trimmed, F.lit("(?s)" + ELEMENT), F.lit(0)), said))


def parts_of(text: Column, delimiter: str) -> Column:
    return F.filter(F.transform(F.split(text, "\\Q" + delimiter + "\\E"), lambda t: strip(t)), lambda t: t != "")


def topic_list(text: Column, delimiter: str = ",") -> Column:
    """Topics in lower case: of a list literal, else of the delimited text; none for null and empty."""
    lower = lambda items: F.transform(items, F.lower)
    trimmed = strip(text)
    nothing = text.isNull() | (trimmed == "") | (trimmed == "[]")
    return F.when(nothing, F.array().cast("array<string>")).otherwise(F.coalesce(lower(as_list(text)), lower(parts_of(text, delimiter))))


def topic_count(text: Column, delimiter: str = ",") -> Column:
    """Number of topics: null and empty 0; a list literal's length; else the non-blank parts if the delimiter occurs, else 1.

    The data dictionary names ``|`` as the delimiter but the pipeline counts by commas; so does the default here.
    """
    trimmed = strip(text)
    count = (
        F.when(text.isNull() | (trimmed == "") | (trimmed == "[]"), 0)
        .when(F.regexp_like(trimmed, F.lit(LIST)), F.size(F.regexp_extract_all(trimmed, F.lit("(?s)" + ELEMENT), F.lit(0))))
        .when(F.contains(trimmed, F.lit(delimiter)), F.size(parts_of(trimmed, delimiter)))
        .otherwise(1)
    )
    return count.cast("int")


def has_topic(text: Column, keywords: list[str]) -> Column:
    """1 if any keyword occurs in the lower-cased text, also within a word; 0 for null."""
    lowered = F.lower(text)
    found = F.lit(False)
    for word in keywords:
        found = found | F.contains(lowered, F.lit(word))
    return F.coalesce(found.cast("int"), F.lit(0))


def topic_flags(text: Column) -> dict[str, Column]:
    return {name: has_topic(text, words) for name, words in TOPIC_KEYWORDS.items()}
