"""Schemas of the tables the operators exchange."""

from __future__ import annotations

REQUIRED_COLUMNS = [
    "DATE",
    "REF",
    "DETAIL",
    "NET",
    "TC",
    "VAT",
    "SUPPLIER",
    "NOMINAL",
    "DEPARTMENT",
]

# Column types after the CSV scan; everything is read as text and cast here.
LINE_TYPES = {
    "DATE": "date",
    "REF": "string",
    "DETAIL": "string",
    "NET": "double",
    "TC": "string",
    "VAT": "double",
    "SUPPLIER": "string",
    "NOMINAL": "string",
    "DEPARTMENT": "string",
}
