"""Routing of messages by ordered rules and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import first_match

# The topics that are never answered automatically, in the order in which they are tested.
RAILS = [
    ("billing_legal", r"(?i)(refund|charge[d]?|bill[ed]?|fraud|unauthorized|sue|lawsuit|attorney|lawyer|court|regulator|fcc|ftc|bbb|consumer\s+protection|arbitration)"),
    ("safety", r"(?i)(kill\s+myself|suicide|self.harm|hurt\s+myself|end\s+my\s+life|don.t\s+want\s+to\s+live)"),
    ("account_takeover", r"(?i)(hacked|someone\s+(else\s+)?logged\s+in|unauthorized\s+(access|login)|account\s+(stolen|compromised|takeover))"),
    ("minor", r"(?i)\b(i\s+am\s+|i'm\s+)?(a\s+)?(minor|under\s+18|underage|child)\b"),
    ("pii_sensitive", r"(?i)(social\s+security|ssn|passport\s+number|credit\s+card\s+number|\bccn\b|\bcvv\b|bank\s+account\s+number)"),
    ("competitor_abuse", r"(?i)(competitor|switch\s+to|moving\s+to|cancell?ing\s+and\s+(going|switching))"),
]


def rail(message: Column) -> Column:
    return first_match(message, RAILS)


def route(message: Column, conf: Column, n_results: Column, tau: float = 0.35, margin: Column | None = None, groundedness: Column | None = None, repeated: Column | None = None) -> Column:
    """struct<action, reason_code, layer>: rails first, then what lacks results or confidence, then auto-handling."""
    margin, groundedness = (F.lit(1.0) if c is None else c for c in (margin, groundedness))
    repeated = F.lit(False) if repeated is None else repeated
    code = F.when(margin < 0.1, "low_intent_confidence").when(groundedness < 0.3, "low_groundedness").when(repeated, "repeated_failure").otherwise("low_calibrated_confidence")
    found = rail(message)
    out = lambda action, reason, layer: F.struct(F.lit(action).alias("action"), reason.alias("reason_code"), F.lit(layer).alias("layer"))
    return (
        F.when(found.isNotNull(), out("escalate", found, 1))
        .when(n_results == 0, out("escalate", F.lit("retrieval_empty"), 2))
        .when(conf < tau, out("escalate", code, 2))
        .otherwise(out("auto_handle", F.lit("passed_all_gates"), 3))
    )


def reason_counts(rows: DataFrame, reason: str) -> DataFrame:
    return rows.groupBy(F.col(reason).alias("reason_code")).agg(F.count("*").alias("n"))
