"""Lexical URL features in three profiles: ``v4``, ``train`` and ``v3``.

Every feature is a built-in expression over the row, so a feature job is one scan
with no shuffle and no Python worker. Columns a query does not use are pruned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlwarden import fixed_values as V
from urlwarden.functions import text as tx
from urlwarden.functions import urls

# Brand lists are unrolled into the plan; longer lists belong in a join.
MAX_BRANDS = 500


@dataclass(frozen=True)
class Profile:
    name: str
    brands: list[str]
    tlds: list[str]
    vector: list[str]
    lexicon: dict[str, list[str]] = field(default_factory=dict)
    keywords: list[str] = field(default_factory=list)

    def __post_init__(self):
        if len(self.brands) > MAX_BRANDS:
            raise ValueError(f"at most {MAX_BRANDS} brands per profile")


PROFILES = {
    "v4": Profile("v4", V.BRANDS_V4, V.TLDS_V4,
                  ["url_length", "digit_ratio", "special_ratio", "num_subdomains", "has_ip",
                   "entropy", "brand_dist", "has_suspicious_tld"],
                  lexicon=V.LEXICON_V4),
    "train": Profile("train", V.BRANDS_TRAIN, V.TLDS_TRAIN,
                     ["url_length", "digit_ratio", "special_ratio", "num_subdomains", "has_ip",
                      "url_entropy", "entropy", "brand_dist", "has_suspicious_tld", "keyword_count"],
                     keywords=V.KEYWORDS_TRAIN),
    "v3": Profile("v3", V.BRANDS_TRAIN, V.TLDS_TRAIN,
                  ["url_length", "domain_length", "path_length", "digit_ratio", "special_ratio",
                   "num_subdomains", "has_ip", "has_punycode", "url_entropy", "entropy",
                   "brand_dist", "has_suspicious_tld", "keyword_count", "has_at_symbol",
                   "is_https", "has_double_slash", "query_param_count"],
                  keywords=V.KEYWORDS_TRAIN),
}


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


# Constant lists become one SQL text each: a list of words costs one call, not one per word.

def _contains_any(column: str, words: list[str]) -> Column:
    return F.expr(" OR ".join(f"contains({column}, {tx.quoted(w)})" for w in words))


def _brand_distances(brands: list[str]) -> Column:
    return F.expr(f"array({', '.join(f'levenshtein(_label, {tx.quoted(b)})' for b in brands)})")


def _lures(lexicon: dict[str, list[str]]) -> Column:
    hits = [f"IF(contains(canonical, {tx.quoted(word)}), "
            f"named_struct('category', {tx.quoted(cat)}, 'keyword', {tx.quoted(word)}), NULL)"
            for cat, words in lexicon.items() for word in words]
    return F.expr(f"array_compact(array({', '.join(hits)}))")


def _keyword_count(words: list[str]) -> Column:
    return F.expr(" + ".join(f"IF(contains(canonical, {tx.quoted(w)}), 1, 0)" for w in words))


def _ends_with(column: str, tlds: list[str]) -> Column:
    return F.expr(" OR ".join(f"endswith({column}, {tx.quoted(t)})" for t in tlds))


def dga_score(label: Column, entropy: Column) -> Column:
    """Score of an algorithmically generated first label; the entropy is that of the host."""
    n = F.length(label)
    points = (F.when(entropy > V.HIGH_ENTROPY, 0.35).otherwise(0.0)
              + F.when(tx.share(tx.count_matches(label, V.VOWEL), n) < 0.2, 0.25).otherwise(0.0)
              + F.when(F.rlike(label, F.lit(V.CONSONANT + "{4,}")), 0.25).otherwise(0.0)
              + F.when(tx.count_matches(label, r"\p{Nd}") > 3, 0.15).otherwise(0.0))
    return F.when(n < 5, 0.0).otherwise(F.round(F.least(F.lit(1.0), points), 2))


def _subdomains_v4(host: Column) -> Column:
    named = F.filter(F.split(host, r"\."), lambda s: (s != "") & ~F.array_contains(tx.literals(V.PLAIN_LABELS), s))
    return F.greatest(F.lit(0), F.size(named) - 1)


def _dots(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))


def _v4(df: DataFrame, p: Profile) -> DataFrame:
    u, host, n = F.col("canonical"), F.col("host"), F.col("url_length")
    df = df.withColumns({
        "digit_ratio": tx.share(tx.count_digits(u, n), n),
        "special_ratio": tx.share(tx.count_matches(u, r"[^\p{L}\p{N}:/.\-]"), n),
        "num_subdomains": _subdomains_v4(host),
        "has_ip": flag(F.rlike(host, F.lit(V.IPV4_PREFIX_PATTERN))),
        "entropy": tx.entropy(host, F.col("domain_length")),
        "url_entropy": tx.entropy(u, n),
        "_dists": _brand_distances(p.brands),
        "has_suspicious_tld": flag(_ends_with("host", p.tlds)),
        "lure_matches": _lures(p.lexicon),
        "has_sensitive_keywords": flag(_contains_any(
            "canonical", [w for words in p.lexicon.values() for w in words])),
        "is_punycode": flag(urls.is_homograph(u)),
    })
    df = df.withColumns({
        "brand_dist": F.array_min("_dists"),
        "dga_score": dga_score(F.col("_label"), F.col("entropy")),
    })
    names = tx.literals(p.brands)
    first = F.array_position(F.col("_dists"), F.col("brand_dist")).cast("int")
    return df.withColumn("matched_brand", F.when(F.col("brand_dist") <= 3, F.element_at(names, first))
                         .otherwise("None"))


def _train(df: DataFrame, p: Profile) -> DataFrame:
    u, host, n = F.col("canonical"), F.col("host"), F.col("url_length")
    slash_tlds = _contains_any("canonical", [t + "/" for t in p.tlds])
    return df.withColumns({
        "digit_ratio": tx.share(tx.count_digits(u, n), n),
        "special_ratio": tx.share(tx.count_matches(u, r"[^\p{L}\p{N}]"), n),
        "num_subdomains": F.greatest(F.lit(0), _dots(u) - 1),
        "has_ip": flag(F.rlike(host, F.lit(V.DIGIT)) & (_dots(host) == 3)),
        "url_entropy": tx.entropy(u, n),
        "entropy": tx.entropy(host, F.col("domain_length")),
        "brand_dist": F.when(host == "", 999).otherwise(
            F.array_min(_brand_distances(p.brands))),
        "has_suspicious_tld": flag(_ends_with("canonical", p.tlds) | slash_tlds),
        "keyword_count": _keyword_count(p.keywords),
    })


def _v3(df: DataFrame, p: Profile) -> DataFrame:
    u, host, n = F.col("canonical"), F.col("host"), F.col("url_length")
    q = F.col("query")
    return df.withColumns({
        "path_length": F.length("path"),
        "digit_ratio": tx.share(tx.count_digits(u, n), n),
        "special_ratio": tx.share(tx.count_matches(u, r"[^\p{L}\p{N}]"), n),
        "num_subdomains": F.greatest(F.lit(0), _dots(host) - 1),
        "has_ip": flag(F.rlike(host, F.lit(V.IPV4_WHOLE_PATTERN))),
        "has_punycode": flag(F.contains(host, F.lit("xn--"))),
        "url_entropy": tx.entropy(u, n),
        "entropy": tx.entropy(host, F.col("domain_length")),
        "brand_dist": F.when(host == "", 999).otherwise(
            F.array_min(_brand_distances(p.brands))),
        "has_suspicious_tld": flag(_ends_with("host", p.tlds)),
        "keyword_count": _keyword_count(p.keywords),
        "has_at_symbol": flag(F.contains(u, F.lit("@"))),
        "is_https": flag(F.col("scheme") == "https"),
        "has_double_slash": flag(F.contains(F.col("path"), F.lit("//"))),
        "query_param_count": F.when(
            q == "", 0).otherwise(F.length(q) - F.length(F.replace(q, F.lit("&"), F.lit(""))) + 1),
    })


_BUILDERS = {"v4": _v4, "train": _train, "v3": _v3}


def url_features(df: DataFrame, url_col: str = "url", profile: str = "v4") -> DataFrame:
    """Add the URL parts and the feature columns of a profile to a table of URLs."""
    p = PROFILES[profile]
    df = urls.with_url_parts(df, url_col)
    if profile == "v3":
        df = df.withColumn("host", F.col("netloc"))
    elif profile == "train":
        u = F.col("canonical")
        df = df.withColumn("host", F.substring_index(F.substring_index(u, "://", -1), "/", 1))
    df = df.withColumns({
        "url_length": F.length("canonical"),
        "domain_length": F.length("host"),
        "_label": urls.first_label(F.col("host")),
    })
    return _BUILDERS[profile](df, p).drop("_dists")


def feature_vector(profile: str = "v4") -> Column:
    return F.array(*[F.col(c).cast("double") for c in PROFILES[profile].vector])
