"""Points in time given by the caller."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(at: datetime) -> Column:
    """A timestamp; without an offset it is read in the session's zone, as stored times are."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp")
