"""Counterparty decision from a service payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.functions.values import lenient_int, lenient_number, payload_body, pick


def counterparty_status(rows: DataFrame, number: str, payload: str) -> DataFrame:
    """Status per row: error without a usable id, debt or count; a manager's case with debt or unsigned papers."""
    clean = F.regexp_replace(F.coalesce(F.col(number), F.lit("")), r"(?U)\s+", "")
    out = (rows.withColumn("_id", clean).withColumn("_body", payload_body(F.col(payload)))
           .withColumn("debt", lenient_number(pick(F.col("_body"), "debt_amount")))
           .withColumn("unsigned", lenient_int(pick(F.col("_body"), "unsigned_eavr_count"))))
    problem = (F.when(~F.col("_id").rlike(r"^\d{12}$"), "invalid_bin")
               .when(F.col("_body").isNull(), "invalid_response")
               .when(F.col("debt").isNull() | F.col("unsigned").isNull(), "invalid_response"))
    status = (F.when(problem.isNotNull(), "error")
              .when((F.col("debt") > 0) | (F.col("unsigned") > 0), "needs_manager").otherwise("ok"))
    return (out.withColumn("status", status).withColumn("error", problem)
            .withColumn("bin", F.col("_id")).drop("_id", "_body"))
