"""Rule-based risk, verdicts and cache lifetimes as expressions over feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlwarden import fixed_values as V


def is_typosquat() -> Column:
    return F.col("brand_dist").between(1, 2)


def is_dga() -> Column:
    return F.col("dga_score") >= V.DGA_ALERT


def heuristic_risk() -> Column:
    w = V.RISK_WEIGHTS
    risk = F.lit(w["base"])
    for condition, part in [
        (is_typosquat(), "typosquat"),
        (is_dga(), "dga"),
        (F.col("has_sensitive_keywords") == 1, "lure"),
        (F.col("has_suspicious_tld") == 1, "tld"),
        (F.col("has_ip") == 1, "ip"),
        (F.col("entropy") > V.HIGH_ENTROPY, "entropy"),
    ]:
        risk = risk + F.when(condition, w[part]).otherwise(0.0)
    # Rounded before any threshold: .05 + .35 must reach .40.
    return F.round(F.least(F.lit(w["cap"]), F.greatest(F.lit(w["floor"]), risk)), 4)


def verdict(risk: Column, thresholds: dict[str, float] = V.THRESHOLDS_V4) -> Column:
    return (F.when(risk >= thresholds["MALICIOUS"], "MALICIOUS")
            .when(risk >= thresholds["SUSPICIOUS"], "SUSPICIOUS")
            .otherwise("SAFE"))


def ttl_seconds(verdict_col: Column) -> Column:
    out = F.when(verdict_col == "MALICIOUS", V.TTL_SECONDS["MALICIOUS"])
    out = out.when(verdict_col == "SUSPICIOUS", V.TTL_SECONDS["SUSPICIOUS"])
    return out.otherwise(V.TTL_SECONDS["SAFE"])


def score(df: DataFrame, thresholds: dict[str, float] = V.THRESHOLDS_V4,
          probability: str | None = None) -> DataFrame:
    """Add risk_score and verdict; a model probability wins where there is one."""
    risk = heuristic_risk()
    if probability is not None:
        risk = F.coalesce(F.round(F.col(probability), 4), risk)
    df = df.withColumn("risk_score", risk)
    return df.withColumn("verdict", verdict(F.col("risk_score"), thresholds))


def score_without_model_v3(df: DataFrame) -> DataFrame:
    """The v3 scorer gives no opinion when no model is loaded."""
    return df.withColumns({"risk_score": F.lit(0.0), "verdict": F.lit("UNKNOWN")})
