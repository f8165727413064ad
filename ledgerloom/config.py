"""Fixed values and column names shared by the whole library."""

from __future__ import annotations

# Label columns of the invoice-line table, and the short names used for them
# in label tuples, vocabularies and predictions.
LABEL_COLUMNS = {"nominal": "NOMINAL", "department": "DEPARTMENT", "tax_code": "TC"}

# Error reports and prediction tables call the tax code "tc".
REPORT_FIELDS = ("nominal", "department", "tc")

# Fixed values that must equal the ones the results are compared with.
TOP_K = 5
TARGET_F1_MACRO = 0.70
MIN_SIMILARITY = 0.45
TEST_SIZE = 0.2
SEED = 42
EMBEDDING_DIM = 384
EMBEDDING_BATCH = 100
