"""Text rules as native column expressions.

Everything here stays inside whole-stage codegen except the rare branch of
``casefold`` that handles letters folding to more than one letter.
"""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The canonical text template, the missing-value label and the
# preview length have to be the same on every run for ids and tables to compare.
TITLE_PREFIX = "标题："
BODY_PREFIX = "正文："
MISSING = "<missing>"
PREVIEW_CHARS = 300

# The code points that Python's str.strip() removes, as the body
# of a regex class that both Java and RE2 read.  The newline is kept apart
# because line-wise stripping must not eat it.
STRIP_CLASS_NO_NEWLINE = (
    r"\t\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
STRIP_CLASS = r"\n" + STRIP_CLASS_NO_NEWLINE
_STRIP_LETTERS = "".join(chr(point) for point in range(0x3001) if chr(point).isspace())

# Letters and digits only.  Java's (?U)\W keeps emoji joiners and variation
# selectors, so the class is spelled through general categories instead.
NON_WORD = r"[^\p{L}\p{N}]+"


def normalize_text(value: Column) -> Column:
    """Whitespace-only normalisation; null becomes the empty string."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t\x{0c}\x{0b}]+", " ")
    # (?d) makes \n the only line terminator, as in a split on "\n".
    edge = f"(?dm)^[{STRIP_CLASS_NO_NEWLINE}]+|[{STRIP_CLASS_NO_NEWLINE}]+$"
    text = F.regexp_replace(text, edge, "")
    text = F.btrim(text, F.lit(_STRIP_LETTERS))
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def canonical_text(
    title: Column,
    body: Column,
    title_prefix: str = TITLE_PREFIX,
    body_prefix: str = BODY_PREFIX,
) -> Column:
    """Model input built from an already normalised title and body."""
    titled = F.concat(F.lit(title_prefix), title)
    bodied = F.concat(F.lit(body_prefix), body)
    return (
        F.when((title != "") & (body != ""), F.concat(titled, F.lit("\n"), bodied))
        .when(body != "", bodied)
        .when(title != "", titled)
        .otherwise(F.lit(""))
    )


def is_title_only(title: Column, body: Column) -> Column:
    return (title != "") & (body == "")


def stable_row_id(label: Column, text: Column) -> Column:
    """Content-based row id: equal for duplicates, independent of partitioning."""
    digest = F.sha1(F.concat_ws("\n", label.cast("string"), text).cast("binary"))
    prefix = F.when(label == 1, F.lit("ai_")).otherwise(F.lit("human_"))
    return F.concat(prefix, F.substring(digest, 1, 16))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Letters whose case fold is not their lower case, split by fold length."""
    single, multi = {}, {}
    for point in range(sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        for letter in chr(point).lower():
            folded = letter.casefold()
            if folded != letter:
                (single if len(folded) == 1 else multi)[letter] = folded
    return "".join(single), "".join(single.values()), multi


def _ranges(letters: str, gap: int = 16) -> str:
    """A short regex class that covers the letters; close neighbours share a range.

    A class of many single letters is tried one by one, which is slow.
    """
    points = sorted(map(ord, letters))
    spans = [[points[0], points[0]]]
    for point in points[1:]:
        if point - spans[-1][1] <= gap:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "[" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in spans) + "]"


def casefold(text: Column) -> Column:
    """Unicode case fold: lower case, then the letters that fold further.

    Equal to Python's ``str.casefold`` on every code point that Python's Unicode
    tables assign; newer letters fold as the JVM lowers them.
    """
    source, target, multi = _fold_tables()
    # The sharp s is common enough to deserve a replacement of its own.
    folded = F.replace(F.translate(F.lower(text), source, target), F.lit("ß"), F.lit("ss"))
    rare = {letter: fold for letter, fold in multi.items() if letter != "ß"}
    lookup = F.create_map(*[F.lit(part) for pair in rare.items() for part in pair])

    def spell_out(value: Column) -> Column:
        letters = F.transform(
            F.split(value, ""), lambda letter: F.coalesce(F.try_element_at(lookup, letter), letter)
        )
        return F.when(value.rlike(_ranges("".join(rare))), F.array_join(letters, "")).otherwise(value)

    # Through a one-element array the chain above runs once per row, not once per branch.
    return F.element_at(F.transform(F.array(folded), spell_out), 1)


def text_fingerprint(text: Column) -> Column:
    """Hash of the text without whitespace, punctuation and emoji, case folded."""
    return F.sha1(casefold(F.regexp_replace(text, NON_WORD, "")).cast("binary"))


def missing_label(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def stratum_key(label: Column, domain: Column | None = None) -> Column:
    """``label`` or ``label__domain``; a null domain is a stratum of its own."""
    if domain is None:
        return label.cast("string")
    return F.concat_ws("__", label.cast("string"), missing_label(domain))


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, chars)


def text_key(text: Column) -> Column:
    """Narrow 64-bit shuffle key; equality is always confirmed on the text itself."""
    return F.xxhash64(text)
