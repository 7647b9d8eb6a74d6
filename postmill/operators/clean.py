"""Row cleaning: normalised title and body, canonical text, row id, drop rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as tx


def _has_ink(value: Column) -> Column:
    """True when normalisation would leave something.

    Asked of the raw value, so the drop filter costs one short regex match
    instead of a second run of the whole normalisation chain.
    """
    return F.coalesce(value.cast("string"), F.lit("")).rlike(f"[^{tx.STRIP_CLASS}]")


def _short_title_only(min_chars: int) -> Column:
    titled = _has_ink(F.col("note_title")) & ~_has_ink(F.col("note_content"))
    return titled & (F.length(tx.normalize_text(F.col("note_title"))) < min_chars)


def clean_posts(df: DataFrame, min_title_only_chars: int = 1) -> DataFrame:
    """Usable rows with ``text``, ``title_only``, ``text_len_chars`` and ``id``.

    The minimum applies to the title of a post without a body, not to the
    templated text around it.
    """
    usable = _has_ink(F.col("note_title")) | _has_ink(F.col("note_content"))
    if min_title_only_chars > 1:
        usable = usable & ~_short_title_only(min_title_only_chars)
    title, body = F.col("note_title"), F.col("note_content")
    return (
        df.where(usable)
        .withColumns({"note_title": tx.normalize_text(title), "note_content": tx.normalize_text(body)})
        .withColumns({"text": tx.canonical_text(title, body), "title_only": tx.is_title_only(title, body)})
        .withColumns(
            {"text_len_chars": F.length("text"), "id": tx.stable_row_id(F.col("label"), F.col("text"))}
        )
    )


def cleaning_report(df: DataFrame, min_title_only_chars: int = 1) -> DataFrame:
    """One row of counts over the rows given to ``clean_posts``."""
    empty = ~_has_ink(F.col("note_title")) & ~_has_ink(F.col("note_content"))
    title_only = _has_ink(F.col("note_title")) & ~_has_ink(F.col("note_content"))
    short = _short_title_only(min_title_only_chars) if min_title_only_chars > 1 else F.lit(False)
    return df.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(empty).alias("dropped_empty_text_rows"),
        F.count_if(short).alias("dropped_short_title_only_rows"),
        F.count_if(title_only & ~short).alias("kept_title_only_rows"),
        F.count_if(~empty & ~short).alias("output_rows"),
    )
