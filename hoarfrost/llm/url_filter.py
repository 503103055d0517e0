"""URL filters: rules by host and path, and a naive Bayes model over segmented words.

Names run together in host labels and paths ("cheappills") are split into
words by unigram Viterbi, with word counts of the pages' own texts and urls.
A multinomial naive Bayes model then scores the words of host and path.

Pages have no labels. What marks a host as unwanted, or a rule as allowed or
blocked as a whole, is evidence: it tells what the model learns from, and the
words that it consists of are no features. So a page's verdict comes from the
other words of its url.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, learnable, named, others, short, written

#: Words up to this length are found in a name through all its substrings, longer ones through their first letters.
SHORT_WORD = 24
#: Heads of a name that are sent on together.
HEADS = 4096


@dataclass(frozen=True)
class UrlRule:
    """allow or block what is under host (and its subdomains) with paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)
# Words that mark a host as unwanted: evidence for the model, never its features.
SEED_WORDS = ("ads", "bets", "betting", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx")


def url_parts(url: Column) -> tuple[Column, Column]:
    """host (ASCII lower case, up to / ? # or the end) and path (up to ? or #); both empty for null or without ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. Of rules with one host and path the first counts."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def shape_of(path: Column) -> Column:
    """path in lower case with a / for every run of other signs than letters: what its words depend on."""
    return F.regexp_replace(F.lower(path), r"[^\p{L}]+", "/")


def names_of(host: Column, path: Column) -> Column:
    """Lower-case runs of letters in host and path."""
    return F.filter(F.split(F.lower(F.concat_ws("/", host, path)), r"[^\p{L}]+"), lambda x: x != "")


def without(text: Column, tag: str) -> Column:
    """text without the elements of a tag, from its opening on to its first closing, or to the end of the text; literal splits, so linear in any text."""
    cut = lambda part: F.when(F.locate(f"</{tag}>", part) > 0, F.substring(part, F.locate(f"</{tag}>", part) + len(tag) + 3, F.length(part))).otherwise("")
    return F.array_join(F.transform(F.split(text, f"<{tag}"), lambda part, k: F.when(k == 0, part).otherwise(cut(part))), " ")


def plain_text(html: Column) -> Column:
    """html in lower case without scripts, styles and tags. A tag ends before the next <, so that signs that open nothing are looked at once."""
    return F.regexp_replace(without(without(F.lower(html), "script"), "style"), r"<[^<>]*>", " ")


def word_counts(pages: DataFrame, url: str = "url", html: str | None = "html") -> DataFrame:
    """(word, n): how often each word is in the pages' texts (tags left out) and, as separate names, in their urls. Summed before the shuffle."""
    names = names_of(*url_parts(named(url)))
    words = pages.select(F.explode(names).alias("word"))
    if html:
        words = words.unionByName(pages.select(F.explode(F.filter(F.split(plain_text(named(html)), r"[^\p{L}]+"), lambda x: x != "")).alias("word")))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(name: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The split of name with the least total cost; an unknown word costs unknown a letter and once more. Ties: the longest last word."""
    lengths = sorted(set(map(len, cost)))
    best, back = [0.0], [0]
    run, since = math.inf, 0  # the least cost if the last word is an unknown one, and where that starts
    for end in range(1, len(name) + 1):
        if run + unknown <= best[end - 1] + 2 * unknown + 1e-12:
            run += unknown
        else:
            run, since = best[end - 1] + 2 * unknown, end - 1
        low, at = run, since
        for n in lengths:
            if n > end:
                break
            if (word := name[end - n : end]) in cost:
                c = best[end - n] + cost[word]
                if c < low - 1e-12 or c < low + 1e-12 and end - n < at:
                    low, at = c, end - n
        best.append(low)
        back.append(at)
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def segment_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """names (name) -> (name, words): each distinct name split by unigram Viterbi with counts (word, n).

    A name's substrings are joined with the counted words, so no vocabulary is
    sent around. Words of over SHORT_WORD letters are joined by their first ones;
    the split takes those that are there whole. Heads are cut in tasks, each
    once, so a name of any length takes linear time. Names are known by hashes meanwhile: names with one hash would
    merely share the words that they are looked up in. A word's cost is the
    negative logarithm of its share, and never more than that of an unknown
    word; a whole name seen twice at most is no word merely because it occurs.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    distinct = names.select("name").distinct().withColumn("id", F.xxhash64("name"))

    def heads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for at in range(0, len(name) - 1, HEADS):
                    heads = list(dict.fromkeys(name[k : k + SHORT_WORD] for k in range(at, min(at + HEADS, len(name) - 1))))
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(heads), pa.int64()), pa.array(heads, pa.string())], names=["id", "head"])

    heads = distinct.where(F.length("name") > 1).select("id", "name").mapInArrow(heads_of, "id long, head string")
    parts = heads.select("id", F.explode(F.transform(F.sequence(F.lit(2), F.length("head")), lambda n: F.substring(F.col("head"), F.lit(1), n))).alias("word"))
    found = parts.distinct().join(counts, "word").select("id", "word", "n")
    long = counts.where(F.length("word") > SHORT_WORD).withColumn("head", F.substring("word", 1, SHORT_WORD))
    there = heads.where(F.length("head") == SHORT_WORD).distinct().join(long, "head")
    found = found.unionByName(there.select("id", "word", "n").distinct())
    known = found.groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    unknown = math.log(max(2, total)) / 2
    grouped = distinct.join(known, "id", "left").select("name", F.coalesce("known", F.array().cast("array<struct<word:string,n:bigint>>")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches):
            out = []
            for name, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cost = {k["word"]: min(math.log(total / k["n"]) + 1, unknown * (1 + len(k["word"]))) for k in known if len(k["word"]) < len(name) or k["n"] > 2}
                out.append(viterbi(name, cost, unknown))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    return grouped.mapInArrow(run, "name string, words array<string>")


def known_by() -> tuple[Column, Column]:
    """Two hashes that stand for a place (host, shape)."""
    return F.xxhash64("host", "shape").alias("pa"), F.xxhash64(F.lit(1), "shape", "host").alias("pb")


def url_words(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct (host, shape) -> the same with words: the split names of host (marked "host:") and of the path's shape.

    Each distinct name is split once and joined back; Spark splits the rows of
    a hot name. Meanwhile a place is known by 128 bits, so that its names don't
    carry its shape along, however long that is.
    """
    places = urls.select("host", "shape").distinct()
    marked = places.select(*known_by(), F.explode(F.concat(
        F.transform(names_of(F.col("host"), F.lit("")), lambda x: F.struct(F.lit("host:").alias("side"), x.alias("name"))),
        F.transform(names_of(F.lit(""), F.col("shape")), lambda x: F.struct(F.lit("path:").alias("side"), x.alias("name"))),
    )).alias("x")).select("pa", "pb", "x.side", "x.name")
    marked = written(marked, "names")
    split = written(segment_names(marked, counts), "split")
    words = marked.join(split, "name").groupBy("pa", "pb").agg(F.flatten(F.collect_list(F.transform("words", lambda w: F.concat("side", w)))).alias("words"))
    return places.select("*", *known_by()).join(words, ["pa", "pb"], "left").select("host", "shape", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def with_evidence(places: DataFrame, rules: tuple[UrlRule, ...], seeds: tuple[str, ...]) -> DataFrame:
    """places (host, shape, words, n) with blocked, and words without those that are evidence.

    blocked is what a rule for a whole host says; else true if the host has a
    seed word, and false for all others, which stand for what isn't unwanted.
    """
    whole = rule_of(F.col("host"), F.lit("/"), tuple(r for r in rules if r.path == "/"))["verdict"]
    telling = [F.lit(side + w) for side in ("host:", "path:") for w in seeds]
    seeded = F.arrays_overlap("words", F.array(*telling[: len(seeds)])) if seeds else F.lit(False)
    left = F.filter("words", lambda w: ~w.isin(*telling)) if seeds else F.col("words")
    return places.select("host", "shape", F.coalesce(whole == "block", seeded, F.lit(False)).alias("blocked"), left.alias("words"), "n")


@dataclass
class NaiveBayes:
    """words: a table (word, odds) of the log odds (block against allow) of each word. prior: those before any word."""

    words: DataFrame
    prior: float


def fit_bayes(labelled: DataFrame) -> NaiveBayes:
    """labelled (words, blocked boolean, n rows alike) -> model, add-one smoothed over the words seen. Counts are summed before the shuffle; only totals reach the driver."""
    classes = {r["blocked"]: r["n"] for r in labelled.groupBy("blocked").agg(F.sum("n").alias("n")).collect() if r["blocked"] is not None}
    rows = labelled.select("blocked", "n", F.explode("words").alias("word"))
    seen = lambda blocked: F.coalesce(F.sum(F.when(F.col("blocked") == blocked, F.col("n"))), F.lit(0))
    sums = written(rows.groupBy("word").agg(seen(True).alias("block"), seen(False).alias("allow")), "sums")
    size, block, allow = sums.agg(F.count(F.lit(1)), F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0))).first()
    odds = F.log((F.col("block") + 1) / F.lit(float(block + max(1, size)))) - F.log((F.col("allow") + 1) / F.lit(float(allow + max(1, size))))
    return NaiveBayes(sums.select("word", odds.alias("odds")), math.log((classes.get(True, 0) + 1) / (classes.get(False, 0) + 1)))


def with_scores(places: DataFrame, model: NaiveBayes) -> DataFrame:
    """places (host, shape, words) -> (host, shape, block_score): the probability of block, to six places. Words that the model doesn't know say nothing."""
    each = places.select(*known_by(), F.explode("words").alias("word")).join(model.words, "word")
    odds = each.groupBy("pa", "pb").agg(F.sum("odds").alias("odds"))
    total = F.coalesce(F.col("odds"), F.lit(0.0)) + F.lit(model.prior)
    return places.select("host", "shape", *known_by()).join(odds, ["pa", "pb"], "left").select("host", "shape", F.round(1 / (1 + F.exp(-total)), 6).alias("block_score"))


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, seeds: tuple[str, ...] = SEED_WORDS, url: str = "url", html: str | None = "html", threshold: float = 0.5, hold_out: bool = False) -> DataFrame:
    """pages without html, with host, path, rule, verdict and block_score.

    The verdict is that of the longest rule that fits, else block if the model's
    score is threshold or more. The model learns from all urls, with the labels
    of with_evidence(); with hold_out not from hosts that learnable() holds out,
    which shows what it makes of hosts that it has never seen. A url that is
    null or has no :// has empty host and path and no words. Repeated rows are
    judged alike, and each counts; of rules with one host and path the first
    counts; an empty table gives an empty result. Columns named like the new
    ones are replaced.
    """
    host, path = url_parts(named(url))
    rest = [c for c in others(pages, "host", "path", "rule", "verdict", "block_score") if c != html]
    shape, score, judged = fresh([*rest, "host", "path"], "url_shape", "url_score", "url_rule")
    split = pages.select(*map(named, rest), host.alias("host"), path.alias("path")).withColumn(shape, shape_of(F.col("path")))
    alike = written(split.groupBy("host", F.col(shape).alias("shape")).agg(F.count(F.lit(1)).alias("n")), "places")
    counts = written(word_counts(pages, url, html), "words")
    places = written(with_evidence(url_words(alike, counts).join(alike, ["host", "shape"]), rules, seeds), "places")
    model = fit_bayes(places.where(learnable(F.col("host"))) if hold_out else places)
    scored = written(with_scores(places, model), "scores").select("host", F.col("shape").alias(shape), F.col("block_score").alias(score))
    out = split.join(scored, ["host", shape], "left").withColumn(judged, rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col(judged)["verdict"], F.when(F.col(score) >= threshold, "block").otherwise("allow"))
    return out.select(*map(named, rest), "host", "path", F.col(judged)["rule"].alias("rule"), verdict.alias("verdict"), F.col(score).alias("block_score"))
