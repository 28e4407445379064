"""Free-text input at the border: control characters out, overlong texts set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions import text as T


def admit(rows: DataFrame, text: str = "query", most: int = V.QUERY_MAX_CHARS) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined).  Accepted texts are stripped of control characters and have
    at most ``most`` characters then; quarantined rows keep their text as it came and say
    why.  A null text is accepted as it is."""
    cleaned = T.strip_control_chars(F.col(text))
    fits = F.coalesce(F.length(cleaned) <= most, F.lit(True))
    accepted = rows.where(fits).withColumn(text, cleaned)
    quarantined = rows.where(~fits).withColumn("quarantine_reason", F.lit("too_long"))
    return accepted, quarantined
