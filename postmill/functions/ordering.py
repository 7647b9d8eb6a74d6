"""Seeded ordering keys: every random choice is a hash of the row's own id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_rank(key: Column, seed: int) -> Column:
    """Hex digest that orders rows at random but reproducibly on any cluster."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
