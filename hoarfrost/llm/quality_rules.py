"""Host-level quality rules: failure rates by host, shrunk towards an empirical beta prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, arrow_schema, fresh, made, mapped, named, others, schema_of, slices, taken, utf8, written

SYMBOLS = b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pairs = a[:-1] * len(ids) + a[1:]
    if len(ids) > 1 << 20:  # keep the triple below 2**63
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(ids) + a[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    start = np.zeros(n + 1, np.int8)
    start[order[1:][same]] = 1
    start[order[:-1][same]] = 1
    covered = start[:n].copy()
    covered[1:] |= start[: n - 1]
    covered[2:] |= start[: n - 2]
    return int(covered.sum())


def text_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one UTF-8 text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    bare = text.translate(None, WHITE)
    chars = len(bare) if bare.isascii() else int(np.count_nonzero((np.frombuffer(bare, np.uint8) & 0xC0) != 0x80))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def with_text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with the columns of STATS in place of any of those names; a null text has no words. One pass, no shuffle."""
    rest = others(docs, text, *(x.split()[0] for x in STATS.split(", ")))
    schema = arrow_schema(STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            cols = list(zip(*map(text_stats, utf8(b, text)))) or [[]] * 5
            stats = made(schema, *cols)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + stats.columns, names=rest + schema.names)

    return mapped(docs, [*rest, text], run, schema_of(docs, rest, STATS))


def failed(min_words: int = 50, max_repeat_pct: int = 50):
    """The base rule: too few words, or too large a share of repeated ones."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))


def host_verdicts(stats: DataFrame, host: str, max_rate: float = 0.5) -> DataFrame:
    """One row a host: documents, failures, shrunk failure rate, host_ok.

    The prior Beta(a, b) is fitted by moments to the rates of all hosts: m is
    their mean and v what of their variance binomial noise doesn't explain; no
    excess variance, or one host only, gives a prior of one document at the
    overall rate. The shrunk rate is (failures + a) / (documents + a + b); a
    host is refused if it is over max_rate. A null host is a host of its own.
    """
    hosts = stats.groupBy(named(host).alias(host)).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    prior = hosts.agg(
        F.count(F.lit(1)).alias("h"), F.avg(rate).alias("m"), F.var_samp(rate).alias("s2"), F.avg(1 / F.col("host_docs")).alias("inv"),
    ).select(
        "m", F.coalesce(F.col("s2") - F.col("m") * (1 - F.col("m")) * F.col("inv"), F.lit(0.0)).alias("v"),
    ).select(
        "m", F.when((F.col("v") > 0) & (F.col("m") > 0) & (F.col("m") < 1), F.greatest(F.col("m") * (1 - F.col("m")) / F.nullif(F.col("v"), F.lit(0.0)) - 1, F.lit(1.0))).otherwise(1.0).alias("weight"),
    )
    shrunk = (F.col("host_failures") + F.col("m") * F.col("weight")) / (F.col("host_docs") + F.col("weight"))
    return (
        hosts.crossJoin(F.broadcast(prior))  # one row: the prior
        .select(named(host), "host_docs", "host_failures", shrunk.alias("host_rate"), (shrunk <= max_rate).alias("host_ok"))
    )


def host_rules(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = 0.5) -> DataFrame:
    """Judge each row of docs by its own text and by its host.

    Adds the columns of STATS, base_failed, host_rate and kept, in place of any
    of those names; the text column is left out. Nulls: a null text has no words and fails; null hosts form one
    host. Repeated rows count each time. An empty table gives an empty result.
    The statistics are written to the shared folder once, since both the host
    rates and the result need them; counts are summed before they are shuffled,
    and the join back has one small row a host, so that Spark may broadcast it
    or split a large host.
    """
    docs = taken(docs, others(docs, "base_failed", "host_rate", "kept"))
    key, ok = fresh(docs.columns, "host_key", "host_fine")
    stats = written(with_text_stats(docs, text).withColumn("base_failed", failed()), "rules")
    hosts = host_verdicts(stats.select(named(host).alias(key), "base_failed"), key, max_rate).select(key, "host_rate", F.col("host_ok").alias(ok))
    judged = stats.join(hosts, named(host).eqNullSafe(F.col(key)), "left").withColumn("kept", ~F.col("base_failed") & F.col(ok))
    return taken(judged, [*stats.columns, "host_rate", "kept"])
