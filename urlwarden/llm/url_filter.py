"""URL filter: longest host and path rule first, else words of the host and naive Bayes.

Host labels are split into words by Viterbi under a unigram model counted over all pages' text.
The words of the host and the tokens of the path feed a multinomial naive Bayes that learns from
the URLs the rules decide.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlwarden.session import materialise

# Host and path of each rule.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@dataclass(frozen=True)
class Params:
    rules: tuple[tuple[str, str, str], ...] = RULES
    unseen: float = 10.0  # an unseen word of n letters counts as 10 ** -n of one occurrence
    smoothing: float = 1.0


def _parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _ruled(p: Params) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, from columns host and path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, say in sorted(p.rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def page_words(pages: DataFrame) -> DataFrame:
    """(word, n) over the visible text of all pages: lower-cased runs of letters and digits."""
    shown = F.regexp_replace(F.regexp_replace(F.lower(F.col("html").cast("string")), r"(?s)<(script|style)\b.*?</\1\s*>", " "), "<[^>]*>", " ")
    words = F.explode(F.split(shown, r"[^\p{L}\p{N}]+"))
    return pages.select(words.alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def best_split(label: str, counts: dict[str, int], total: int, p: Params) -> list[str]:
    """The likeliest split of a host label into words; of equal ones that with the shorter last word.

    Words of any length take part. A counted word is tried where it ends; an unseen one grows letter
    by letter from its best start, so a label costs its length times the lengths of its counted words.
    """
    lengths = sorted({len(w) for w in counts})
    letter, opening = log(p.unseen), log(total)
    best: list[tuple[float, int]] = [(0.0, 0)]
    unseen = (-opening, 0)  # score of an unseen word of no letters so far, less what its start saves
    for end in range(1, len(label) + 1):
        unseen = max(unseen, (best[end - 1][0] - opening + (end - 1) * letter, end - 1))
        tries = [(unseen[0] - end * letter, unseen[1])]
        for size in lengths:
            if size > end:
                break
            n = counts.get(label[end - size : end])
            if n:
                tries.append((best[end - size][0] + log(n / total), end - size))
        best.append(max(tries))
    out, end = [], len(label)
    while end:
        start = best[end][1]
        out.append(label[start:end])
        end = start
    return out[::-1]


def host_words(hosts: DataFrame, words: DataFrame, p: Params = Params()) -> DataFrame:
    """(host, words) of distinct hosts. Only words that occur in a label are looked up, by a join.

    Every piece of a label that is as long as some counted word is looked up; these lengths are
    numbers up to the longest label.
    """
    total = words.agg(F.sum("n")).first()[0] or 1
    labels = hosts.select("host", F.explode(F.split("host", r"[^\p{L}\p{N}]+")).alias("label")).where("label != ''")
    one = labels.select("label").distinct()
    longest = one.agg(F.max(F.length("label"))).first()[0] or 0
    sizes = [r["size"] for r in words.select(F.length("word").alias("size")).where(F.col("size") <= longest).distinct().collect()]
    lengths = F.explode(F.array(*[F.lit(n) for n in sorted(sizes)]).cast("array<int>")).alias("size")
    starts = F.explode(F.sequence(F.lit(1), F.length("label") - F.col("size") + 1)).alias("start")
    pieces = one.select("label", lengths).where(F.length("label") >= F.col("size")).select("label", "size", starts).select(
        "label", F.col("label").substr(F.col("start"), F.col("size")).alias("word")).distinct()
    known = pieces.join(words, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(label: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([best_split(x, {k["word"]: k["n"] for k in ([] if ks is None else ks)}, total, p) for x, ks in zip(label, known)])

    parts = one.join(known, "label", "left").select("label", split("label", "known").alias("words"))
    return (labels.join(parts, "label").groupBy("host").agg(F.flatten(F.sort_array(F.collect_list("words"))).alias("words")))


def _tokens(urls: DataFrame) -> DataFrame:
    """(host, path, token): host words as h:word, path parts as p:part with digits told by their number."""
    raw = F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    path = F.transform(raw, lambda x: F.concat(F.lit("p:"), F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(x).cast("string"))).otherwise(x)))
    host = F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda x: F.concat(F.lit("h:"), x))
    return urls.select("host", "path", "seen", "verdict", F.explode(F.concat(host, path)).alias("token"))


def judge(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """(page_id, host, path, rule, verdict, odds, words) of each row of pages (page_id, url, html, any others).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins.
    Other URLs are blocked where naive Bayes gives block the better odds (log odds above 0); ties,
    and all URLs while the rules know only one verdict or none, are allowed. A null url has empty
    host and path and is judged alike; a null html adds no words. Repeated rows count as often as
    they occur. An empty table gives no rows.
    """
    host, path = _parts(F.col("url").cast("string"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    # Work goes over distinct URLs with their counts, so a host with a third of all rows is few.
    rule, verdict = _ruled(p)
    urls = materialise(base.groupBy("host", "path").agg(F.count("*").alias("seen")).withColumn("rule", rule).withColumn("verdict", verdict), "urls")
    words = materialise(page_words(pages), "words")
    split = materialise(host_words(urls.select("host").distinct(), words, p), "hosts")
    tokens = materialise(_tokens(urls.join(split, "host", "left")), "tokens")
    n = {(r["verdict"]): r["n"] for r in urls.where("verdict IS NOT NULL").groupBy("verdict").agg(F.sum("seen").alias("n")).collect()}
    if len(n) < 2:
        odds = urls.select("host", "path", F.lit(0.0).alias("odds"))
    else:
        seen = F.sum(F.when(F.col("verdict") == "block", F.col("seen")).otherwise(0)), F.sum(F.when(F.col("verdict") == "allow", F.col("seen")).otherwise(0))
        counts = materialise(tokens.where("verdict IS NOT NULL").groupBy("token").agg(seen[0].alias("b"), seen[1].alias("a")), "counts")
        size, block, allow = counts.agg(F.count("*"), F.sum("b"), F.sum("a")).first()
        s = p.smoothing
        weight = F.log((F.col("b") + s) / (block + s * size)) - F.log((F.col("a") + s) / (allow + s * size))
        prior = log(n["block"] / n["allow"])
        weights = counts.select("token", weight.alias("weight"))
        sums = tokens.where("verdict IS NULL").join(weights, "token").groupBy("host", "path").agg(F.sum("weight").alias("w"))
        odds = urls.join(sums, ["host", "path"], "left").select("host", "path", (F.coalesce("w", F.lit(0.0)) + prior).alias("odds"))
    said = urls.join(odds, ["host", "path"]).join(split, "host", "left").select(
        "host", "path", "rule", F.coalesce("verdict", F.when(F.col("odds") > 0, "block").otherwise("allow")).alias("verdict"), "odds", "words")
    return base.join(said, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "odds", "words")
