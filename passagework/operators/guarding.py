"""The guard stage over a table of queries or any text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.defaults import INJECTION_THRESHOLD
from passagework.functions.guard import injection_assessment, redact_pii
from passagework.operators.fusion import valid_query


def guard_queries(
    queries: DataFrame,
    text: str = "text",
    threshold: float = INJECTION_THRESHOLD,
    detect_injection: bool = True,
    redact: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(safe, refused).

    Refused rows have a `reason`: the length is outside the limits, or the raw text
    scores as an injection. Safe rows have the text redacted and `pii_redacted`.
    The injection score is JVM-side and runs before any text reaches Python.
    """
    rows = queries
    checks = F.when(~F.coalesce(valid_query(F.col(text)), F.lit(False)), "length")
    if detect_injection:
        rows = rows.withColumn("injection", injection_assessment(F.col(text), threshold))
        checks = checks.when(F.col("injection.blocked"), "injection")
    rows = rows.withColumn("reason", checks)
    refused = rows.filter(F.col("reason").isNotNull())
    safe = rows.filter(F.col("reason").isNull()).drop("reason", "injection")
    if not redact:
        return safe.withColumn("pii_redacted", F.lit(False)), refused
    scanned = safe.withColumn("_scan", redact_pii(F.col(text)))
    safe = (
        scanned.withColumn("pii_redacted", F.size("_scan.matches") > 0)
        .withColumn(text, F.col("_scan.text"))
        .drop("_scan")
    )
    return safe, refused
