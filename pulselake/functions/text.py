"""Text search over logs and traces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Joins label values for one search; no label value is expected to hold this control character.
SEPARATOR = "\u0001"


def log_text(text: str | None, message: str = "message", labels: str = "labels") -> Column:
    """The message or any label value contains the text, case ignored. Keys and level do not count."""
    if not text:
        return F.lit(True)
    wanted = text.lower()
    values = F.map_values(F.col(labels))
    if SEPARATOR in wanted:
        in_labels = F.exists(values, lambda v: F.contains(F.lower(v), F.lit(wanted)))
    else:
        in_labels = F.contains(F.lower(F.concat_ws(SEPARATOR, values)), F.lit(wanted))
    return F.coalesce(F.contains(F.lower(F.col(message)), F.lit(wanted)), F.lit(False)) | F.coalesce(
        in_labels, F.lit(False)
    )


def trace_text(text: str | None) -> Column:
    """Trace id, service or span name contains the text; case counts."""
    if not text:
        return F.lit(True)
    hits = [
        F.coalesce(F.contains(F.col(c), F.lit(text)), F.lit(False)) for c in ("trace_id", "service", "span_name")
    ]
    return hits[0] | hits[1] | hits[2]


def has_identity() -> Column:
    """Points without a trace id or span id belong to no trace."""
    return F.col("trace_id").isNotNull() & F.col("span_id").isNotNull()
