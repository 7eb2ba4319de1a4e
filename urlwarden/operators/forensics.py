"""Explanations of a verdict: techniques, indicators, actions, summary, attribution, reports.

All of them are array or text expressions over the feature columns of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlwarden import fixed_values as V
from urlwarden.functions.risk import is_dga, is_typosquat
from urlwarden.functions.text import literals, quoted, unnest


def _rules() -> dict[str, Column]:
    return {
        "typosquat": is_typosquat(),
        "homograph": F.col("is_punycode") == 1,
        "dga": is_dga(),
        "lure": F.col("has_sensitive_keywords") == 1,
        "ip": F.col("has_ip") == 1,
        "tld": F.col("has_suspicious_tld") == 1,
        "subdomains": F.col("num_subdomains") >= 2,
        "entropy": F.col("entropy") > V.HIGH_ENTROPY,
    }


def _percent(value: Column, digits: int) -> Column:
    # Half-even, as the texts are defined; the formatter alone would round half up.
    return F.bround(value * 100, digits)


def _technique(name: str) -> Column:
    tid, text = V.TECHNIQUES[name]
    return F.expr(f"named_struct('id', {quoted(tid)}, 'name', {quoted(text)})")


def techniques() -> Column:
    r = _rules()
    found = F.array_compact(F.array(*[
        F.when(r[k], _technique(k)) for k in ("typosquat", "homograph", "dga", "lure", "ip")]))
    return F.when((F.size(found) == 0) & (F.col("verdict") != "SAFE"),
                  F.array(_technique("fallback"))).otherwise(found)


def indicators() -> Column:
    r = _rules()
    tokens = F.transform(F.slice("lure_matches", 1, 3),
                         lambda m: F.format_string("'%s' (%s)", m["keyword"], m["category"]))
    texts = {
        "typosquat": F.format_string(V.INDICATORS["typosquat"], F.upper("matched_brand"), F.col("brand_dist")),
        "homograph": F.lit(V.INDICATORS["homograph"]),
        "dga": F.format_string(V.INDICATORS["dga"], _percent(F.col("dga_score"), 0), F.bround("entropy", 2)),
        "lure": F.format_string(V.INDICATORS["lure"], F.array_join(tokens, ", ")),
        "ip": F.lit(V.INDICATORS["ip"]),
        "tld": F.lit(V.INDICATORS["tld"]),
        "subdomains": F.format_string(V.INDICATORS["subdomains"], F.col("num_subdomains")),
    }
    found = [F.when(r[k], t) for k, t in texts.items()]
    found.append(F.when(F.col("verdict") == "SAFE", V.INDICATORS["safe"]))
    return F.array_compact(F.array(*found))


def anomaly_count() -> Column:
    """Number of rule indicators; the closing text of safe URLs does not count."""
    r = _rules()
    total = F.lit(0)
    for k in ("typosquat", "homograph", "dga", "lure", "ip", "tld", "subdomains"):
        total = total + F.when(r[k], 1).otherwise(0)
    return total


def playbook_actions() -> Column:
    by_rule = F.when(is_typosquat(), literals(V.ACTIONS["typosquat"])).otherwise(
        F.array().cast("array<string>"))
    by_verdict = (F.when(F.col("verdict") == "MALICIOUS", literals(V.ACTIONS["MALICIOUS"]))
                  .when(F.col("verdict") == "SUSPICIOUS", literals(V.ACTIONS["SUSPICIOUS"]))
                  .otherwise(literals(V.ACTIONS["SAFE"])))
    return F.concat(by_rule, by_verdict)


def summary() -> Column:
    n = anomaly_count()
    return (F.when(F.col("verdict") == "MALICIOUS", F.format_string(
                V.SUMMARIES["MALICIOUS"], _percent(F.col("risk_score"), 1), n))
            .when(F.col("verdict") == "SUSPICIOUS", F.format_string(V.SUMMARIES["SUSPICIOUS"], n))
            .otherwise(V.SUMMARIES["SAFE"]))


def xai_attribution() -> Column:
    """Ordered (feature, contribution) pairs; the percentages differ from the risk weights."""
    r = _rules()

    def pair(key: str, text: Column | None = None) -> Column:
        name, fixed = V.CONTRIBUTIONS[key]
        if text is None:
            return F.expr(f"named_struct('feature', {quoted(name)}, 'contribution', {quoted(fixed)})")
        return F.struct(F.lit(name).alias("feature"), text.alias("contribution"))

    dga = F.format_string(V.CONTRIBUTIONS["dga"][1], F.bround(F.col("dga_score") * 30, 1))
    found = F.array_compact(F.array(
        F.when(r["typosquat"], pair("typosquat")),
        F.when(r["dga"], pair("dga", dga)),
        F.when(r["lure"], pair("lure")),
        F.when(r["tld"], pair("tld")),
        F.when(r["ip"], pair("ip")),
        F.when(r["entropy"], pair("entropy"))))
    return F.when(F.size(found) == 0, F.array(pair("none"))).otherwise(found)


def metric_texts() -> dict[str, Column]:
    brand = F.when(F.col("brand_dist") <= 3, F.format_string(
        "%d (%s)", F.col("brand_dist"), F.col("matched_brand"))).otherwise("0 (Clean)")
    return {
        "entropy": F.format_string("%.2f Bits/Char", F.bround("entropy", 2)),
        "brand_dist": brand,
        "subdomains": F.format_string("%d Levels", F.col("num_subdomains")),
        "digit_ratio": F.format_string("%.1f%%", _percent(F.col("digit_ratio"), 1)),
        "dga_score": F.format_string("%.0f%%", _percent(F.col("dga_score"), 0)),
        "punycode": F.when(F.col("is_punycode") == 1, "Detected (Homograph Risk)").otherwise("Clean ASCII"),
    }


def _record(summary_text, ttps, inds, actions, metrics, xai) -> Column:
    return F.struct(
        summary_text.alias("summary"), ttps.alias("mitre_ttps"), inds.alias("indicators"),
        actions.alias("playbook_actions"), *[c.alias(k) for k, c in metrics.items()],
        xai.alias("xai_attribution"))


def scorer_forensics() -> Column:
    return _record(summary(), techniques(), indicators(), playbook_actions(), metric_texts(),
                   xai_attribution())


_NO_PAIRS = "array<struct<feature:string,contribution:string>>"
_NO_TTPS = "array<struct<id:string,name:string>>"


def tier_forensics(kind: str, url: Column, risk: Column) -> Column:
    """Fixed record of allow-listed or cached scans; only the dot count and risk vary."""
    dots = F.length(url) - F.length(F.replace(url, F.lit("."), F.lit("")))
    fixed = V.TIER_METRICS[kind]
    metrics = {
        "entropy": F.lit(fixed["entropy"]), "brand_dist": F.lit(fixed["brand_dist"]),
        "subdomains": F.format_string("%d Levels", F.greatest(F.lit(0), dots - 1)),
        "digit_ratio": F.lit(fixed["digit_ratio"]), "dga_score": F.lit(fixed["dga_score"]),
        "punycode": F.lit(fixed["punycode"]),
    }
    if kind == "cached":
        text = F.format_string(V.SUMMARIES["cached"], _percent(risk, 1))
        ttps = F.array(_technique("cached"))
    else:
        text, ttps = F.lit(V.SUMMARIES["allowed"]), F.array().cast(_NO_TTPS)
    return _record(text, ttps, literals([V.INDICATORS[kind]]), literals(V.ACTIONS[kind]), metrics,
                   F.array().cast(_NO_PAIRS))


def with_forensics(scored: DataFrame) -> DataFrame:
    return scored.withColumn("forensics", scorer_forensics())


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        V.TECHNIQUE_CATALOGUE,
        "technique_id string, name string, tactic string, tactic_id string, description string")


def mitre_rollup(scored: DataFrame, techniques_table: DataFrame) -> DataFrame:
    """Scans per technique and tactic; ids missing in the catalogue keep a null tactic.

    Counted before the join, so the join sees one row per technique id.
    """
    counts = unnest(scored, [], techniques(), "t").groupBy(
        F.col("t.id").alias("technique_id")).agg(F.count("*").alias("n"))
    return counts.join(techniques_table.select("technique_id", "name", "tactic"), "technique_id", "left")


def incident_report(url: Column, verdict: Column, risk: Column, source: Column) -> Column:
    return F.format_string(V.INCIDENT_REPORT, url, verdict, _percent(risk, 1), source)


def technique_report(technique_id: Column, name: Column, tactic: Column, description: Column) -> Column:
    return F.format_string(V.TECHNIQUE_REPORT, technique_id, name, tactic, description)
