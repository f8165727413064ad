"""Reading model answers: JSON with seven required members, or three labelled lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_reasoning

LABELS = ("nominal", "department", "tax_code")
CONFIDENCES = tuple(f"{name}_confidence" for name in LABELS)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_json_response(df: DataFrame, response: str = "response") -> DataFrame:
    """Add the members of a JSON answer, ``valid`` and a ``reason`` code.

    Reasons are ``not_json``, ``missing:<member>`` and ``range:<member>``; the
    first that applies is given, and ``ok`` otherwise.  Labels and confidences of
    an invalid answer are null.  The text is parsed once, in a step of its own:
    one big expression would parse it for every member and every check.
    """
    read = df.withColumn("_answer", F.try_parse_json(response))
    answer = F.col("_answer")

    def text(name: str) -> Column:
        """A member that is text; numbers are not taken for labels."""
        value = F.try_variant_get(answer, f"$.{name}", "variant")
        is_text = F.schema_of_variant(value) == "STRING"
        return F.when(is_text, F.try_variant_get(answer, f"$.{name}", "string"))

    members = {f"_{n}": text(n) for n in (*LABELS, "reasoning")}
    members |= {f"_{n}": F.try_variant_get(answer, f"$.{n}", "double") for n in CONFIDENCES}
    is_object = F.coalesce(F.schema_of_variant(answer).startswith("OBJECT"), F.lit(False))
    read = read.withColumns({**members, "_object": is_object})
    reason = F.when(~F.col("_object"), "not_json")
    for name in (*LABELS, *CONFIDENCES, "reasoning"):
        reason = reason.when(F.col(f"_{name}").isNull(), f"missing:{name}")
    for name in CONFIDENCES:
        value = F.col(f"_{name}")
        reason = reason.when(~value.between(0.0, 1.0) | F.isnan(value), f"range:{name}")
    judged = read.withColumn("reason", reason.otherwise("ok"))
    valid = F.col("reason") == "ok"
    return judged.withColumns(
        {
            **{n: F.when(valid, F.col(f"_{n}")) for n in (*LABELS, *CONFIDENCES)},
            "reasoning": F.when(valid, clean_reasoning("_reasoning")).otherwise(""),
            "valid": valid,
        }
    ).drop("_answer", "_object", *members)


def parse_line_response(response: Column | str) -> Column:
    """Labels from ``NOMINAL:``, ``DEPARTMENT:`` and ``TC:`` lines.

    The last line with a prefix counts; a missing one gives the empty string.
    """
    lines = F.transform(
        F.split(F.coalesce(_col(response), F.lit("")), "\n"),
        lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""),
    )

    def last(prefix: str) -> Column:
        found = F.filter(lines, lambda x: F.startswith(x, F.lit(prefix)))
        value = F.replace(F.try_element_at(found, F.lit(-1)), F.lit(prefix), F.lit(""))
        return F.coalesce(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit(""))

    return F.struct(
        last("NOMINAL:").alias("nominal"),
        last("DEPARTMENT:").alias("department"),
        last("TC:").alias("tax_code"),
    )
