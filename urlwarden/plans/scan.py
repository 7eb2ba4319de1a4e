"""The scan cascade: allow-list, then cached verdicts, then the scorer."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlwarden import fixed_values as V
from urlwarden.functions.lexical import url_features
from urlwarden.functions.risk import score, ttl_seconds
from urlwarden.functions.text import strip
from urlwarden.functions.urls import canonical, with_url_hash
from urlwarden.operators import forensics as fx
from urlwarden.operators.allowlist import allow_match
from urlwarden.operators.replay import ttl_replay
from urlwarden.operators.verdicts import first_seen, lookup_verdicts
from urlwarden.session import materialise


def _address_pattern() -> str:
    """A lower-cased IPv6 address, the last 32 bits also in IPv4 form, with an optional zone."""
    h, octet = "[0-9a-f]{1,4}", "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    four = rf"{octet}(?:\.{octet}){{3}}"
    forms = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{6}}{four}"]
    for left in range(8):  # groups before the gap; at most 7 in all
        head = f"{h}(?::{h}){{{left - 1}}}::" if left else "::"
        forms.append(head + (f"(?:{h}(?::{h}){{0,{6 - left}}})?" if left < 7 else ""))
        if left < 6:
            forms.append(head + f"(?:{h}:){{0,{5 - left}}}{four}")
    return f"(?:{'|'.join(forms)})(?:%[^%]+)?"


ADDRESS = rf"^(?:v[0-9a-f]+\.[^\n]+|{_address_pattern()})$"
# Characters whose compatibility form holds a delimiter of URLs.
DELIMITER_FORMS = "".join(c for c in map(chr, range(0x80, 0xFFFF)) if set("/?#@:") & set(unicodedata.normalize("NFKC", c)))


def _url_text(url: Column) -> Column:
    return F.coalesce(canonical(url), F.lit(""))


def _host_part(u: Column) -> Column:
    """The host part that with_url_parts finds in a canonical URL."""
    full = F.translate(F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("http://"), u)), "\t\r\n", "")
    return F.regexp_extract(full, r"^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)", 1)


def _reason(u: Column, netloc: Column) -> Column:
    opened, closed = F.contains(netloc, F.lit("[")), F.contains(netloc, F.lit("]"))
    address = F.substring_index(F.regexp_extract(netloc, r"\[(.*)$", 1), "]", 1)
    # All forms are longer than one byte, so most hosts need no search.
    wide = F.octet_length(netloc) > F.length(netloc)
    return (F.when(u == "", "blank url").when(opened != closed, "unbalanced brackets in host")
            .when(opened & ~address.rlike(ADDRESS), "bad address in brackets")
            .when(wide & F.rlike(F.lower(netloc), F.lit(f"[{DELIMITER_FORMS}]")), "delimiter in another form in host"))


def reject_reason(url: Column) -> Column:
    """Why a request cannot be scanned; null if it can.

    The host part is the one that with_url_parts finds. Brackets in it must come in pairs, and the
    first must hold an IPv6 address or a version tag.
    """
    u = _url_text(url)
    return _reason(u, _host_part(u))


def with_reject_reason(requests: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``reason`` as ``reject_reason`` tells it, each step computed once a row.

    It leaves as an inlined struct: filters on it stay here, behind the dealing of the rows, and are
    not pushed down to the few tasks that read the table.
    """
    df = requests.withColumn("_u", _url_text(F.col(url_col)))
    df = df.withColumn("_netloc", _host_part(F.col("_u")))
    reason = _reason(F.col("_u"), F.col("_netloc")).alias("reason")
    return df.select(*[c for c in requests.columns if c != "reason"], F.inline(F.array(F.struct(reason))))


def split_requests(requests: DataFrame, url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """Accepted requests and rejects. Rejects do not stop the batch."""
    marked = with_reject_reason(requests, url_col)
    return (marked.where(F.col("reason").isNull()).drop("reason"),
            marked.where(F.col("reason").isNotNull()))


def resolve_tiers(df: DataFrame) -> DataFrame:
    """Pick verdict, source, risk and forensics by tier.

    Expects the feature, score, ``allowed``, ``hit``, ``cached_verdict`` and ``cached_risk``
    columns. The branches are plain expressions, so picking them costs no join and no shuffle.
    """
    allowed, hit = F.col("allowed"), F.col("hit") == 1
    url = strip(F.col("url"))
    record = (F.when(allowed, fx.tier_forensics("allowed", url, F.lit(0.0)))
              .when(hit, fx.tier_forensics("cached", url, F.col("cached_risk")))
              .otherwise(fx.scorer_forensics()))
    return df.withColumn("forensics", record).withColumns({
        "source": F.when(allowed, V.SOURCE_ALLOW).when(hit, V.SOURCE_CACHE).otherwise(V.SOURCE_SCORER),
        "verdict": F.when(allowed, "SAFE").when(hit, F.col("cached_verdict")).otherwise(F.col("verdict")),
        "risk_score": F.when(allowed, 0.0).when(hit, F.col("cached_risk")).otherwise(F.col("risk_score")),
    })


def scored_requests(requests: DataFrame, allow: DataFrame | None = None, strict: bool = False,
                    probability: str | None = None) -> DataFrame:
    """Features, scorer result and allow-list decision of every request, without a shuffle."""
    return allow_match(score(url_features(requests), probability=probability), allow, strict)


def scan(requests: DataFrame, entries: DataFrame | None = None, allow: DataFrame | None = None,
         strict: bool = False, probability: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan requests (scan_id, ts, url, …) against the verdict entries.

    Returns the results (request columns, verdict, source, risk_score, forensics) and the rejects.
    """
    accepted, rejects = split_requests(requests)
    keep = accepted.columns
    if entries is None:
        looked = accepted.withColumns({
            "cached_verdict": F.lit(None).cast("string"),
            "cached_risk": F.lit(None).cast("double"), "hit": F.lit(0)})
    else:
        looked = lookup_verdicts(accepted, entries)
    done = resolve_tiers(scored_requests(looked, allow, strict, probability))
    out = [c for c in keep if c not in ("verdict", "source", "risk_score", "forensics")]
    return done.select(*out, "verdict", "source", "risk_score", "forensics"), rejects


def scan_over_time(requests: DataFrame, allow: DataFrame | None = None,
                   strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The cascade over a log (scan_id, ts, url, …) that starts with an empty cache.

    A scan the allow-list does not know is scored unless an entry of its URL is alive; a scored
    one writes an entry that lives as long as its verdict says. Returns results and rejects.
    """
    accepted, rejects = split_requests(requests)
    scored = materialise(with_url_hash(scored_requests(accepted, allow, strict)), "scored")
    asked = scored.where(~F.col("allowed")).select(
        "scan_id", "ts", "url_hash", ttl_seconds(F.col("verdict")).alias("ttl"))
    hits = ttl_replay(asked).select("scan_id", "hit")
    done = resolve_tiers(scored.join(hits, "scan_id", "left").withColumns({
        "cached_verdict": F.col("verdict"), "cached_risk": F.col("risk_score")}))
    out = [c for c in accepted.columns if c not in ("verdict", "source", "risk_score", "forensics")]
    return done.select(*out, "verdict", "source", "risk_score", "forensics"), rejects


def scan_batch(requests: DataFrame, allow: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """One batch at one moment: the first scan of a URL is scored, its repeats are cache hits."""
    accepted, _ = split_requests(requests)
    keep = accepted.columns
    marked = first_seen(accepted)
    scored = scored_requests(marked, allow, strict).withColumns({
        "hit": 1 - F.col("is_first"), "cached_verdict": F.col("verdict"),
        "cached_risk": F.col("risk_score")})
    return resolve_tiers(scored).select(*keep, "verdict", "source", "risk_score", "forensics")


def batch_report(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("processed_count"))
