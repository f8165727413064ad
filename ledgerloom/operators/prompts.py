"""Prompt columns: few-shot block, chat messages and plain prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import example_excerpt
from ledgerloom.functions.vectors import similarity_text

SYSTEM_TEXT = (
    "You code accounts-payable invoice lines for a finance department.\n"
    "Every line gets a nominal ledger code, a department and a tax code.\n"
    "Past lines and their codes are given; let them decide first, then the supplier.\n"
    "Answer with one JSON object and a short reason, without showing your working."
)

ANSWER_TEXT = (
    'Answer only with JSON that has exactly these members: "nominal", "department", '
    '"tax_code" (text), "nominal_confidence", "department_confidence", '
    '"tax_code_confidence" (numbers from 0 to 1) and "reasoning" (two or three sentences '
    "that name the past lines the choice rests on; never empty)."
)

PLAIN_ANSWER_TEXT = "Answer with these three lines and nothing else:"


def few_shot_block(examples: str = "examples") -> Column:
    """Five lines of text per example, in rank order."""
    lines = F.transform(
        examples,
        lambda e: F.concat(
            F.lit("- text: "), F.coalesce(e["text"], F.lit("")),
            F.lit("\n  nominal: "), F.coalesce(e["nominal"], F.lit("")),
            F.lit("\n  department: "), F.coalesce(e["department"], F.lit("")),
            F.lit("\n  tax_code: "), F.coalesce(e["tax_code"], F.lit("")),
            F.lit("\n  similarity: "), similarity_text(1 - e["distance"]),
        ),
    )
    return F.array_join(lines, "\n")


def build_few_shot_block(nested: DataFrame) -> DataFrame:
    """Add ``few_shot_examples`` to a table of nested examples."""
    return nested.withColumn("few_shot_examples", few_shot_block())


def chat_prompt(items: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Add ``system_prompt`` and ``user_prompt`` to lines with nested examples.

    ``items`` has ``DETAIL, SUPPLIER, NET, VAT`` and ``examples``.  The
    vocabularies are short lists and enter the plan as literals.
    """

    def shown(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    def amount(column: str) -> Column:
        """Plain decimals without an exponent; up to six places, trailing zeros cut but for one."""
        plain = F.col(column).cast("decimal(38,6)").cast("string")
        return F.coalesce(F.regexp_replace(plain, r"(\.\d+?)0+$", "$1"), F.lit(""))

    user = F.concat(
        F.lit("Code this invoice line.\n\nDETAIL: "), shown("DETAIL"),
        F.lit("\nSUPPLIER: "), shown("SUPPLIER"),
        F.lit("\nNET: "), amount("NET"),
        F.lit("\nVAT: "), amount("VAT"),
        F.lit("\n\nMost similar past lines:\n"), few_shot_block(),
        *[
            F.lit(f"{lead}{title} may be one of: {vocabulary[name]}")
            for lead, title, name in (
                ("\n\n", "NOMINAL", "nominal"),
                ("\n", "DEPARTMENT", "department"),
                ("\n", "TAX CODE", "tax_code"),
            )
        ],
        F.lit(f"\n\n{ANSWER_TEXT}"),
    )
    return items.withColumns({"system_prompt": F.lit(SYSTEM_TEXT), "user_prompt": user})


def plain_prompt(
    items: DataFrame, vocabulary: dict[str, list[str]], text: str = "model_text"
) -> DataFrame:
    """Add ``prompt`` for models that answer in lines; shows ten nominal labels."""
    numbered = F.transform(
        "examples",
        lambda e, i: F.concat(
            F.lit("Example "), (i + 1).cast("string"), F.lit(": "), example_excerpt(e["text"]),
            F.lit("\n  NOMINAL: "), F.coalesce(e["nominal"], F.lit("")),
            F.lit(", DEPARTMENT: "), F.coalesce(e["department"], F.lit("")),
            F.lit(", TC: "), F.coalesce(e["tax_code"], F.lit("")),
        ),
    )
    head = (
        "Code an invoice line.\n\nLabels:"
        f"\nNOMINAL: {', '.join(vocabulary['nominal'][:10])}..."
        f"\nDEPARTMENT: {', '.join(vocabulary['department'])}"
        f"\nTC: {', '.join(vocabulary['tax_code'])}"
        "\n\nSimilar past lines:\n"
    )
    tail = f"\n\n{PLAIN_ANSWER_TEXT}\nNOMINAL: <label>\nDEPARTMENT: <label>\nTC: <label>"
    prompt = F.concat(
        F.lit(head), F.array_join(numbered, "\n"),
        F.lit("\n\nThe line to code:\n"), F.col(text), F.lit(tail),
    )
    return items.withColumn("prompt", prompt)

