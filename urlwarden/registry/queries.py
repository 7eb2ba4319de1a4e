"""One callable per operator: (spark, sf_dir) -> DataFrame over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlwarden import fixed_values as V
from urlwarden.functions import urls as U
from urlwarden.functions.lexical import PROFILES, feature_vector, url_features
from urlwarden.functions.risk import score, ttl_seconds
from urlwarden.functions.text import unnest
from urlwarden.operators import (allowlist, approx_neighbours, forensics, lookalikes, metrics, neighbours, ngrams, quantiles,
                                 outliers, ranges, resample, scaling, split, telemetry, verdicts)
from urlwarden.operators import online_logit as online
from urlwarden.operators.extra_trees import fit_extra_trees
from urlwarden.operators.network import enrich_network
from urlwarden.operators.replay import ttl_replay
from urlwarden.plans import prepare, train
from urlwarden.plans import scan as scan_plan
from urlwarden.registry import corpora as C
from urlwarden.session import materialise, workspace
from urlwarden.sources import allow_text, labeled, manifest, telemetry_store
from urlwarden.streaming import scan_stream, stats_stream, ttl_stream

KEY = ["corpus", "url_id"]


def _r6(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def _longs(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# ---- sources and sinks ------------------------------------------------------

def src_labeled_urls(spark, sf):
    path = workspace(spark, "labeled")
    labeled.write_labeled_urls(C.scan_requests(spark, sf), path)
    return labeled.read_labeled_urls(spark, path)


def src_template_corpus(spark, sf):
    path = workspace(spark, "corpus")
    return labeled.load_or_build(spark, path, C.page_urls(spark, sf), C.doc_urls(spark, sf))


def _custom_allow(spark, sf) -> DataFrame:
    """Page hosts written as an allow-list text file with comments and blank lines."""
    path = workspace(spark, "allow")
    host = F.regexp_extract("url", "//([^/?#]*)", 1)
    line = F.explode(F.array(F.concat(F.lit("  "), F.upper(host), F.lit("\t")), F.lit(""),
                             F.concat(F.lit("# "), F.col("url"))))
    C.page_urls(spark, sf).select(line.alias("value")).write.text(path)
    return allow_text.read_allow_text(spark, path)


def src_custom_allowlist(spark, sf):
    return _custom_allow(spark, sf)


def sink_telemetry(spark, sf):
    path = workspace(spark, "telemetry")
    log = C.telemetry(spark, sf)
    telemetry_store.append_telemetry(log, path)
    back = telemetry_store.read_telemetry(spark, path)
    return back.select("id", "url", "verdict", F.col("scan_date").cast("string").alias("scan_date"),
                       F.col("forensics.summary").alias("summary"))


def dataset_fingerprint(spark, sf):
    return manifest.fingerprint(C.all_urls(spark, sf))


# ---- normalisation ----------------------------------------------------------

def url_canonical(spark, sf):
    return C.all_urls(spark, sf).select(*KEY, U.canonical(F.col("url")).alias("canonical"))


def url_hash(spark, sf):
    return U.with_url_hash(C.all_urls(spark, sf), prefix="verdict:").select(*KEY, "url_hash")


def url_parts(spark, sf):
    return U.with_url_parts(C.all_urls(spark, sf)).select(
        *KEY, "scheme", "netloc", "path", "query", "host")


def allow_domain(spark, sf):
    return U.with_domain(U.with_url_parts(C.all_urls(spark, sf))).select(*KEY, "domain")


def network_host(spark, sf):
    return C.all_urls(spark, sf).select(*KEY, U.network_host(F.col("url")).alias("network_host"))


def apex_domain(spark, sf):
    return U.with_domain(U.with_url_parts(C.all_urls(spark, sf))).select(*KEY, "apex")


# ---- features ---------------------------------------------------------------

def _features(spark, sf, profile="v4") -> DataFrame:
    return url_features(C.all_urls(spark, sf), profile=profile)


def feat_v4_ratios(spark, sf):
    return _features(spark, sf).select(
        *KEY, *_longs("url_length", "domain_length"), *_r6("digit_ratio", "special_ratio"))


def feat_v4_structure(spark, sf):
    return _features(spark, sf).select(*KEY, *_longs("num_subdomains", "has_ip", "has_suspicious_tld"))


def feat_entropy(spark, sf):
    return _features(spark, sf).select(*KEY, *_r6("entropy", "url_entropy"))


def feat_brand(spark, sf):
    return _features(spark, sf).select(*KEY, *_longs("brand_dist"), "matched_brand")


def feat_lures(spark, sf):
    text = F.array_join(F.transform("lure_matches", lambda m: F.concat(
        m["category"], F.lit(":"), m["keyword"])), ",")
    return _features(spark, sf).select(*KEY, text.alias("lures"), *_longs("has_sensitive_keywords"))


def feat_homograph(spark, sf):
    return _features(spark, sf).select(*KEY, *_longs("is_punycode"))


def feat_dga(spark, sf):
    return _features(spark, sf).select(*KEY, "dga_score")


def _numbered(spark, sf, profile):
    df = _features(spark, sf, profile).withColumn("v", feature_vector(profile))
    n = len(PROFILES[profile].vector)
    return df.select(*KEY, *[F.round(F.col("v")[i], 6).alias(f"f{i + 1}") for i in range(n)])


def feat_vector_v4(spark, sf):
    return _numbered(spark, sf, "v4")


def feat_train10(spark, sf):
    return _numbered(spark, sf, "train")


def feat_v3_17(spark, sf):
    return _numbered(spark, sf, "v3")


def feat_payload(spark, sf):
    from urlwarden.functions.text import text_features
    df = text_features(C.spread(C.table(spark, sf, "documents").select("doc_id", "text")), "text")
    return df.select("doc_id", "shannon_entropy", *_longs("char_length"), "digit_ratio",
                     "special_char_ratio", "uppercase_ratio")


def brand_lookalikes(spark, sf):
    found = lookalikes.brand_lookalikes(C.all_urls(spark, sf))
    return found.select("label", "brand", *_longs("distance"), "n_urls")


def brand_table(spark, sf):
    found = lookalikes.brand_table_lookalikes(C.all_urls(spark, sf), C.frequent_words(spark, sf))
    return found.select("label", "brand", *_longs("distance"), "n_urls")


def lure_counts(spark, sf):
    return lookalikes.lure_counts(C.all_urls(spark, sf))


# ---- allow-list -------------------------------------------------------------

def _allow(spark, sf) -> DataFrame:
    return allowlist.allow_table(spark, _custom_allow(spark, sf))


def allow_match(spark, sf):
    df = allowlist.allow_decision(C.all_urls(spark, sf), _allow(spark, sf))
    return df.select(*KEY, F.col("listed").cast("int").alias("listed"))


def _decided(spark, sf, **kw) -> DataFrame:
    return allowlist.allow_decision(C.all_urls(spark, sf), **kw)


def allow_pattern(spark, sf):
    return _decided(spark, sf).select(*KEY, F.col("trusted").cast("int").alias("trusted"))


def allow_suffix(spark, sf):
    """Hosts that end like a page host without its first label."""
    host = F.lower(F.regexp_extract("url", "//([^/?#:]*)", 1))
    pages = C.page_urls(spark, sf).select(F.regexp_replace(host, r"^[^.]*\.", "").alias("suffix"))
    return allowlist.suffix_match(U.with_domain(U.with_url_parts(C.all_urls(spark, sf))), pages).select(*KEY, "suffix")


def allow_guard(spark, sf):
    return _decided(spark, sf).where(~F.col("guarded")).select(*KEY, "domain")


def allow_decision(spark, sf):
    return _decided(spark, sf).select(*KEY, F.col("allowed").cast("int").alias("allowed"))


def _userinfo_scans(spark, sf) -> DataFrame:
    """Scan requests with every second one given a misleading userinfo part."""
    s = C.scan_requests(spark, sf)
    url = F.when(F.col("scan_id") % 2 == 0, F.regexp_replace(
        "url", "(?i)^( *https?://)", "$1google.com:x@")).otherwise(F.col("url"))
    return s.select("scan_id", url.alias("url"))


def allow_decision_strict(spark, sf):
    scans = _userinfo_scans(spark, sf)
    strict = allowlist.allow_decision(scans, strict=True)
    loose = F.col("allowed").cast("int")
    both = allowlist.allow_match(
        strict.withColumn("allowed_strict", loose).drop("domain", "apex", "listed", "guarded", "trusted"))
    return both.select("scan_id", "domain", "allowed_strict", loose.alias("allowed"))


def allow_rejects(spark, sf):
    return _decided(spark, sf).where(~F.col("allowed")).select(*KEY, "url")


def allow_add(spark, sf):
    new = U.with_url_parts(C.all_urls(spark, sf)).select(
        F.concat(F.lit(" "), F.col("netloc"), F.lit("\t")).alias("domain"))
    return allowlist.add_domains(allowlist.allow_table(spark), new)


def allow_stats(spark, sf):
    return allowlist.allow_stats(_allow(spark, sf))


def allow_decision_v3(spark, sf):
    df = allowlist.allow_decision_v3(C.all_urls(spark, sf))
    return df.select(*KEY, F.col("allowed").cast("int").alias("allowed"))


# ---- verdict cache ----------------------------------------------------------

def cache_lookup(spark, sf):
    looked = verdicts.lookup_verdicts(C.scan_requests(spark, sf), C.verdict_history(spark, sf))
    return looked.select("scan_id", F.col("cached_verdict").alias("verdict"),
                         F.col("cached_risk").alias("risk_score"), "hit")


def _upserted(spark, sf) -> DataFrame:
    scored = C.cacheable_scans(spark, sf)
    later = verdicts.new_entries(scored.where(F.col("event_type") == "purchase"), F.col("ts"))
    return verdicts.upsert_verdicts(C.verdict_history(spark, sf), later)


def cache_upsert(spark, sf):
    return _upserted(spark, sf).select("url_hash", "verdict", "risk_score", "cached_at", "expires_at")


def cache_purge(spark, sf):
    gone = C.scan_requests(spark, sf).where(F.col("event_type") == "error").select("url")
    return verdicts.purge_verdicts(_upserted(spark, sf), gone).select("url_hash", "verdict")


def cache_expire(spark, sf):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return verdicts.expire_verdicts(_upserted(spark, sf), now).select("url_hash", "expires_at")


def cache_stats(spark, sf):
    history = C.verdict_history(spark, sf)
    looked = verdicts.lookup_verdicts(C.cacheable_scans(spark, sf).select("scan_id", "ts", "url"), history)
    return verdicts.cache_stats(looked, history)


def _replay_input(spark, sf) -> DataFrame:
    scored = U.with_url_hash(C.cacheable_scans(spark, sf))
    return scored.select("scan_id", "ts", "url_hash", ttl_seconds(F.col("verdict")).alias("ttl"))


def cache_ttl_replay(spark, sf):
    return ttl_replay(_replay_input(spark, sf)).select("scan_id", "hit")


def batch_first_seen(spark, sf):
    marked = verdicts.first_seen(C.scan_requests(spark, sf))
    return marked.select("scan_id", "url_hash", "is_first")


# ---- risk, verdict, cascade -------------------------------------------------

def risk_heuristic(spark, sf):
    return score(_features(spark, sf)).select(*KEY, "risk_score")


def risk_verdict(spark, sf):
    from urlwarden.functions.risk import verdict
    df = score(_features(spark, sf))
    return df.select(*KEY, "verdict", verdict(F.col("risk_score"), V.THRESHOLDS_V3).alias("verdict_v3"))


def scan_cascade(spark, sf):
    results, _ = scan_plan.scan(C.scan_requests(spark, sf), C.verdict_history(spark, sf))
    return results.select("scan_id", "verdict", "source", "risk_score",
                          F.col("forensics.summary").alias("summary"),
                          F.col("forensics.subdomains").alias("subdomains"),
                          F.array_join("forensics.indicators", " | ").alias("indicators"),
                          F.array_join("forensics.playbook_actions", " | ").alias("actions"))


def scan_batch(spark, sf):
    results = scan_plan.scan_batch(C.scan_requests(spark, sf))
    return results.select("scan_id", "verdict", "source", "risk_score")


def _raw_requests(spark, sf) -> DataFrame:
    """Every text piece between full stops as a raw request, blank pieces included; most come in a
    form with brackets, in turn."""
    d = C.spread(C.table(spark, sf, "documents").select("doc_id", "text"))
    pieces = d.select("doc_id", F.posexplode(F.split("text", r"\.")).alias("pos", "url"))
    url = F.element_at(F.split(F.trim("url"), " "), 1)
    form = F.col("url")
    for i, (head, tail) in enumerate(C.BRACKET_FORMS, start=1):
        form = F.when(F.col("pos") % (len(C.BRACKET_FORMS) + 1) == i, F.concat(F.lit(head), url, F.lit(tail))).otherwise(form)
    return pieces.withColumn("url", form)


def scan_rejects(spark, sf):
    _, rejects = scan_plan.split_requests(_raw_requests(spark, sf))
    return rejects.select("doc_id", "pos", "reason")


def enrich_asn(spark, sf):
    df = enrich_network(C.scan_requests(spark, sf), C.dns(spark, sf))
    return df.select("scan_id", "resolved_ip", "asn_owner")


def enrich_asn_ranges(spark, sf):
    scans = enrich_network(C.scan_requests(spark, sf), C.dns(spark, sf)).select("scan_id", "resolved_ip")
    found = ranges.match_ranges(scans.withColumn("ip_number", ranges.ip_number(F.col("resolved_ip"))), C.ip_ranges(spark, sf))
    return found.select("scan_id", "resolved_ip", "owner")


# ---- forensics --------------------------------------------------------------

def _scored(spark, sf) -> DataFrame:
    return score(_features(spark, sf))


def mitre_tags(spark, sf):
    df = unnest(_scored(spark, sf), KEY, forensics.techniques(), "t", "pos")
    return df.select(*KEY, "pos", F.col("t.id").alias("technique_id"), F.col("t.name").alias("technique"))


def indicators(spark, sf):
    return unnest(_scored(spark, sf), KEY, forensics.indicators(), "text", "pos")


def playbook_actions(spark, sf):
    return unnest(_scored(spark, sf), KEY, forensics.playbook_actions(), "text", "pos")


def threat_summary(spark, sf):
    return _scored(spark, sf).select(*KEY, forensics.summary().alias("summary"))


def xai_attribution(spark, sf):
    df = unnest(_scored(spark, sf), KEY, forensics.xai_attribution(), "p", "pos")
    return df.select(*KEY, "pos", "p.feature", "p.contribution")


def forensic_metrics(spark, sf):
    texts = forensics.metric_texts()
    return _scored(spark, sf).select(*KEY, *[c.alias(k) for k, c in texts.items()])


def mitre_rollup(spark, sf):
    return forensics.mitre_rollup(_scored(spark, sf), forensics.catalogue(spark))


def technique_report(spark, sf):
    """A report for each catalogued technique that scored URLs show, with their number."""
    table = forensics.catalogue(spark)
    rollup = forensics.mitre_rollup(_scored(spark, sf), table).select("technique_id", "n")
    text = forensics.technique_report(*(F.col(c) for c in ("technique_id", "name", "tactic", "description")))
    return rollup.join(table, "technique_id").select("technique_id", "n", text.alias("report"))


def incident_report(spark, sf):
    log = telemetry_store.read_log(spark, C.stored_log(spark, sf))
    text = forensics.incident_report(F.col("url"), F.col("verdict"), F.col("risk_score"), F.col("source"))
    return log.select("id", text.alias("report"))


# ---- telemetry --------------------------------------------------------------

LOG = ["id", "url", "verdict", "source", "risk_score", "latency", "timestamp", "resolved_ip", "asn_owner"]


def _sums(spark, sf) -> DataFrame:
    return telemetry_store.read_sums(spark, C.stored_log(spark, sf))


def log_recent(spark, sf):
    return telemetry_store.newest(spark, C.stored_log(spark, sf), 50).select(*LOG)


def log_detail(spark, sf):
    return telemetry.log_detail(telemetry_store.read_log(spark, C.stored_log(spark, sf)).select(*LOG))


def stats_recent(spark, sf):
    return telemetry.stats(telemetry_store.newest(spark, C.stored_log(spark, sf), 200))


def stats_all(spark, sf):
    return telemetry.stats_of_sums(_sums(spark, sf))


def verdict_counts(spark, sf):
    return telemetry.verdict_counts_of_sums(_sums(spark, sf))


def tier_counts(spark, sf):
    return telemetry.tier_counts_of_sums(_sums(spark, sf))


def log_json(spark, sf):
    return telemetry.log_json(telemetry_store.read_log(spark, C.stored_log(spark, sf)),
                              ["id", "url", "verdict", "source", "resolved_ip", "asn_owner", "http_status"])


def log_json_back(spark, sf):
    """Every column of the log through JSON and back."""
    log = telemetry_store.read_log(spark, C.stored_log(spark, sf)).drop("scan_date")
    rows = telemetry.log_json(log, log.columns)
    back = telemetry.read_log_json(rows, log.schema)
    return back.select(*LOG, "http_status", F.col("forensics.summary").alias("summary"),
                       F.array_join("forensics.indicators", " | ").alias("indicators"))


# ---- streams ----------------------------------------------------------------

SLICES = 6


def _feed(spark, sf, columns: list[str]):
    """Scan requests as a stream of files in SLICES steps of time, about a step per micro-batch."""
    scans = C.scan_requests(spark, sf).select(*columns)
    path = workspace(spark, "feed")
    ends = scans.agg(F.unix_micros(F.min("ts")).alias("lo"), F.unix_micros(F.max("ts")).alias("hi")).first()
    width = (ends["hi"] - ends["lo"]) // SLICES + 1
    piece = F.floor((F.unix_micros("ts") - ends["lo"]) / width)
    for i in range(SLICES):  # one after the other: the source takes files by age
        scans.where(piece == i).write.mode("append").parquet(path)
    files = max(1, len(spark.read.parquet(path).inputFiles()) // SLICES)
    return spark.readStream.schema(scans.schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_scan(spark, sf):
    root = workspace(spark, "scan-stream")
    source = _feed(spark, sf, ["scan_id", "ts", "url", "latency"])
    scan_stream.start_scan_stream(source, root).awaitTermination()
    out = spark.read.parquet(f"{root}/telemetry")
    return out.select("scan_id", "url", "verdict", "source", "risk_score", F.col("forensics.summary").alias("summary"))


def stream_ttl_state(spark, sf):
    root = workspace(spark, "ttl-stream")
    source = _feed(spark, sf, ["scan_id", "ts", "url"])
    scored = U.with_url_hash(scan_plan.scored_requests(source).where(~F.col("allowed")))
    keyed = scored.select("scan_id", "ts", "url_hash", ttl_seconds(F.col("verdict")).alias("ttl"))
    ttl_stream.start_ttl_stream(keyed, root).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("scan_id", "hit")


def stream_stats(spark, sf):
    root = workspace(spark, "stats-stream")
    source = _feed(spark, sf, ["ts", "url", "latency"])
    stats_stream.start_stats_stream(score(url_features(source)), root).awaitTermination()
    stats = stats_stream.latest_stats(spark, root)
    return stats.select("window_start", "verdict", "n", *_r6("avg_latency"))


# ---- training and scoring ---------------------------------------------------

def ngrams_char(spark, sf):
    return ngrams.char_gram_counts(C.all_urls(spark, sf), ["corpus"])


def ngrams_word(spark, sf):
    urls = C.all_urls(spark, sf)
    buckets = max(spark.sparkContext.defaultParallelism, -(-C.stored_bytes(urls) // C.BUCKET_BYTES))
    return ngrams.word_gram_counts(urls, ["corpus"], buckets=buckets)


def tfidf_vocab(spark, sf):
    return ngrams.most_frequent(ngrams.char_gram_counts(C.all_urls(spark, sf), []), ngrams.CHAR_TERMS)


def tfidf_weights(spark, sf):
    urls = C.all_urls(spark, sf)
    model = ngrams.fit_char_tfidf(urls)
    return ngrams.char_tfidf_rows(model, urls, KEY).select(*KEY, "term", *_r6("weight"))


def scale_standard(spark, sf):
    p = materialise(C.payloads(spark, sf), "payloads")
    scaled = scaling.apply_scale(p, scaling.fit_standard(p, C.PAYLOAD_FEATURES))
    return scaled.select("doc_id", *_r6(*C.PAYLOAD_FEATURES))


def binary_metrics(spark, sf):
    scored = materialise(C.scored_scans(spark, sf).select("label", "risk_score"), "scored")
    m = metrics.binary_metrics(scored, "label", "risk_score", F.col("risk_score") >= V.THRESHOLDS_V4["SUSPICIOUS"])
    return m.select(*_r6(*m.columns))


def _labeled(spark, sf) -> DataFrame:
    return C.scan_requests(spark, sf).select("url", "label")


_TRAINED: dict[tuple[str, str], str] = {}


def _trained(spark, sf) -> str:
    """Folder of the training run over the scan requests: model, cv and manifest.

    Trained once per session and data set; the queries below read what the run wrote.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        path = train.model_path(spark)
        train.train(_labeled(spark, sf), path)
        _TRAINED[key] = path
    return _TRAINED[key]


def train_manifest(spark, sf):
    return spark.read.json(f"{_trained(spark, sf)}/manifest")


def cv_metrics(spark, sf):
    return spark.read.parquet(f"{_trained(spark, sf)}/cv")


def _model(spark, sf):
    return train.load_model(f"{_trained(spark, sf)}/model")


def ensemble_score(spark, sf):
    return train.score_urls(_model(spark, sf), C.scan_requests(spark, sf)).select("scan_id", "probability")


def risk_model(spark, sf):
    scored = train.score_urls(_model(spark, sf), C.scan_requests(spark, sf))
    return score(url_features(scored), probability="probability").select("scan_id", "risk_score", "verdict")


def batch_score(spark, sf):
    return train.score_urls(_model(spark, sf), C.all_urls(spark, sf)).select(*KEY, "probability")


def hashing_logit(spark, sf):
    model = train.fit_hashing_logit(_labeled(spark, sf))
    return train.score_hashing_logit(model, C.scan_requests(spark, sf)).select("scan_id", "probability")


def online_logit(spark, sf):
    """Scores of all scan requests by the online learner over hashed character n-grams."""
    data = train.training_set(_labeled(spark, sf)).select("id", "url", "label", "weight")
    grams = ngrams.char_wb_grams_stage()
    model = online.fit_online(grams.transform(data), "id", "wb_grams", "label", "weight")
    return _score_distinct(spark, sf, lambda urls: model.score(grams.transform(urls).select("url", "wb_grams"), "wb_grams"))


def _score_distinct(spark, sf, scored) -> DataFrame:
    """Probabilities of all scan requests; each distinct canonical URL is scored once."""
    scans = C.scan_requests(spark, sf).select("scan_id", U.canonical(F.col("url")).alias("url"))
    found = materialise(scored(scans.select("url").distinct()).select("url", *_r6("probability")), "scores")
    return scans.join(found, "url", "left").select("scan_id", "probability")


def extra_tree(spark, sf):
    """The nodes of one extra-tree of two levels over all payloads."""
    p = materialise(C.payloads(spark, sf), "payloads")
    model = fit_extra_trees(p, C.PAYLOAD_FEATURES, "target", trees=1, depth=2, tried=2)
    nodes = model.nodes.astype({"node": "int64", "feature": "int64", "cut": "float64", "n": "int64", "pos": "int64"})
    return spark.createDataFrame(nodes[["node", "feature", "cut", "n", "pos"]]).withColumn("cut", F.round("cut", 6))


def extra_trees(spark, sf):
    """Scores of all scan requests by extra-trees over the ten lexical features."""
    data = train.training_set(_labeled(spark, sf))
    model = fit_extra_trees(data, train.LEXICAL, "label", "weight")
    return _score_distinct(spark, sf, lambda urls: model.score(url_features(urls, profile="train")))


# ---- dataset preparation ----------------------------------------------------

def prep_features(spark, sf):
    p = C.payloads(spark, sf)
    return p.select("doc_id", "n_chars", "shannon_entropy", *_longs("char_length"), "digit_ratio",
                    "special_char_ratio", "uppercase_ratio", "target")


def split_stratified(spark, sf):
    labels = C.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("target"))
    both = split.folds(split.split(labels, "doc_id", "target"), "doc_id", "target")
    return both.select("doc_id", "target", "split", "fold")


def _train_rows(spark, sf) -> tuple[DataFrame, DataFrame]:
    data = materialise(split.split(C.payloads(spark, sf), "doc_id", "target"), "payload-split")
    return data, data.where(F.col("split") == "train")


def scale_robust(spark, sf):
    data, fit_on = _train_rows(spark, sf)
    scaled = scaling.apply_scale(data, scaling.fit_robust(fit_on, C.PAYLOAD_FEATURES))
    return scaled.select("doc_id", "split", *_r6(*C.PAYLOAD_FEATURES))


def quantile_sketch(spark, sf):
    """Quantiles of event values per type from stored sketches of days, and whether their ranks hold."""
    events = C.table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), F.col("value").cast("double").alias("value"))
    days = materialise(quantiles.quantile_sketches(events, ["value"], ["event_type", "day"]), "sketches")
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    found = materialise(quantiles.merge_sketches(days, ["event_type"], probs).withColumnRenamed("value", "q"), "quantiles")
    # A row per type and rank: some tens, joined by type.
    below = events.join(found.select("event_type", "prob", "q"), "event_type").groupBy("event_type", "prob").agg(
        F.count_if(F.col("value") < F.col("q")).alias("below"), F.count_if(F.col("value") <= F.col("q")).alias("upto"))
    slack = F.col("n") * quantiles.SKETCH_ERROR + 1
    place = F.col("prob") * F.col("n")
    return found.join(below, ["event_type", "prob"]).select(
        "event_type", "prob", "n", ((F.col("below") <= place + slack) & (F.col("upto") >= place - slack)).alias("within"))


def power_yeojohnson(spark, sf):
    events = C.table(spark, sf, "events").select("event_id", "value")
    lams = scaling.fit_power(events, ["value"], refine=2)
    y = scaling.apply_power(events, lams)
    z = scaling.apply_scale(y, scaling.fit_standard(y, ["value"]))
    return z.select("event_id", F.lit(lams["value"]).alias("lam"), *_r6("value"))


def class_balance(spark, sf):
    _, fit_on = _train_rows(spark, sf)
    before = resample.class_counts(fit_on, "target").withColumn("stage", F.lit("train"))
    labels = C.table(spark, sf, "labels").select(F.col("toxic").alias("target"))
    whole = resample.class_counts(labels, "target").withColumn("stage", F.lit("all"))
    return whole.unionByName(before)


def _prep_vectors(spark, sf) -> DataFrame:
    """Robust-scaled train rows as (id, vec, label)."""
    _, fit_on = _train_rows(spark, sf)
    scaled = scaling.apply_scale(fit_on, scaling.fit_robust(fit_on, C.PAYLOAD_FEATURES))
    return scaled.select(F.col("doc_id").alias("id"),
                         F.array(*[F.col(c) for c in C.PAYLOAD_FEATURES]).alias("vec"),
                         F.col("target").alias("label"))


def outlier_iforest(spark, sf):
    rows = materialise(_prep_vectors(spark, sf), "forest-rows")
    marked = outliers.fit_forest(rows).inliers(rows)
    return marked.select("id", *_r6("score"), "is_inlier")


def _flat(df: DataFrame) -> DataFrame:
    return df.select("id", "label", *[F.round(F.col("vec")[i], 6).alias(c)
                                      for i, c in enumerate(C.PAYLOAD_FEATURES)])


def resample_smote(spark, sf):
    return _flat(resample.smote(_prep_vectors(spark, sf)))


def resample_smote_tomek(spark, sf):
    return _flat(resample.smote_tomek(_prep_vectors(spark, sf)))


def resample_adasyn(spark, sf):
    return _flat(resample.adasyn(_prep_vectors(spark, sf)))


def neighbours_lsh(spark, sf):
    """The five nearest other vectors of every twentieth one, among all."""
    e = C.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return approx_neighbours.lsh_knn(e.withColumn("is_query", F.col("id") % 20 == 0), 5)


def tomek_links(spark, sf):
    e = C.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return neighbours.tomek_links(e)


def prep_dataset(spark, sf):
    splits, fitted = prepare.prepare(C.payloads(spark, sf), "doc_id", "target", C.PAYLOAD_FEATURES)
    path = workspace(spark, "prepared")
    prepare.write_prepared(splits, fitted, path)
    parts = [spark.read.parquet(f"{path}/{name}").withColumn("split", F.lit(name)) for name in splits]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("split", "target").agg(F.count("*").alias("n"))


KEYS = """
src_labeled_urls src_template_corpus src_custom_allowlist sink_telemetry dataset_fingerprint
url_canonical url_hash url_parts allow_domain network_host apex_domain
feat_v4_ratios feat_v4_structure feat_entropy feat_brand feat_lures feat_homograph feat_dga
feat_vector_v4 feat_train10 feat_v3_17 feat_payload brand_lookalikes brand_table lure_counts
allow_match allow_pattern allow_suffix allow_guard allow_decision allow_decision_strict allow_rejects allow_add
allow_stats allow_decision_v3
cache_lookup cache_upsert cache_purge cache_expire cache_stats cache_ttl_replay batch_first_seen
risk_heuristic risk_verdict scan_cascade scan_batch scan_rejects enrich_asn enrich_asn_ranges
mitre_tags indicators playbook_actions threat_summary xai_attribution forensic_metrics mitre_rollup
incident_report technique_report
log_recent log_detail stats_recent stats_all verdict_counts tier_counts log_json log_json_back
stream_scan stream_ttl_state stream_stats
ngrams_char ngrams_word tfidf_vocab tfidf_weights scale_standard binary_metrics hashing_logit online_logit extra_tree extra_trees
ensemble_score risk_model batch_score cv_metrics train_manifest
prep_features split_stratified scale_robust quantile_sketch power_yeojohnson class_balance outlier_iforest
resample_smote resample_smote_tomek resample_adasyn tomek_links neighbours_lsh prep_dataset
""".split()


def queries() -> dict:
    return {k: globals()[k] for k in KEYS}
