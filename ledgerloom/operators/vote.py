"""Local scorer over retrieved examples: a similarity-weighted vote per field.

It stands in for a hosted model and works on the nested examples of each query,
so it adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import LABEL_COLUMNS


def _vote(field: str) -> Column:
    """Label with the highest summed similarity; ties go to the smaller label."""
    examples = F.filter("examples", lambda e: e[field].isNotNull())

    def weight(e: Column) -> Column:
        return F.greatest(e["similarity"], F.lit(0.0))

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + weight(e))

    labels = F.array_distinct(F.transform(examples, lambda e: e[field]))
    scored = F.transform(
        labels,
        lambda label: F.struct(
            (-F.round(total(F.filter(examples, lambda e: e[field] == label)), 9)).alias("order"),
            label.alias("label"),
        ),
    )
    best = F.array_min(scored)
    share = F.coalesce(F.try_divide(-best["order"], total(examples)), F.lit(0.0))
    return F.struct(best["label"].alias("label"), share.alias("confidence"))


def vote(nested: DataFrame) -> DataFrame:
    """Add the three labels, their confidences (shares of the vote) and a reason."""
    fields = list(LABEL_COLUMNS)
    picked = nested.withColumns({f"_{f}": _vote(f) for f in fields})
    reason = F.format_string(
        "%d similar lines, nearest: %s", F.size("examples"), F.try_element_at("examples", F.lit(1))["text"]
    )
    confidence = F.create_map(
        *[x for f in fields for x in (F.lit(f), F.col(f"_{f}")["confidence"])]
    )
    return picked.withColumns(
        {
            **{f: F.col(f"_{f}")["label"] for f in fields},
            "confidence": confidence,
            "reasoning": reason,
        }
    ).drop(*[f"_{f}" for f in fields])
