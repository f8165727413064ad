"""Label comparison in which a missing label never matches anything."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.config import REPORT_FIELDS


def labels_match(true: Column | str, pred: Column | str) -> Column:
    true = F.col(true) if isinstance(true, str) else true
    pred = F.col(pred) if isinstance(pred, str) else pred
    return F.coalesce(true == pred, F.lit(False))


def field_match(field: str) -> Column:
    return labels_match(f"true_{field}", f"pred_{field}")


def all_match() -> Column:
    return reduce(and_, [field_match(f) for f in REPORT_FIELDS])


def wrong_fields() -> Column:
    """How many of the three fields are wrong."""
    return sum(((~field_match(f)).cast("int") for f in REPORT_FIELDS), F.lit(0))
