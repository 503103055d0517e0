"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality_model, sql
from .byte_bpe import encode_texts
from .circulant_minhash import near_duplicate_sets
from .common import learnable, ship, table
from .filter_audit import failure_masks, interaction_audit
from .packing import pack, token_pieces
from .periodic_runs import find_runs
from .progressive_jpeg import read_media, store_media
from .quality_rules import host_rules
from .secret_scan import BASE_RULES, scan_secrets
from .simhash import hex_fingerprint, near_duplicates
from .suffix_dedup import remove_repeats
from .url_filter import judge_urls

#: Score from which on a text counts as good.
GOOD = 0.3
#: Tokens of a packed sequence.
SEQUENCE = 2048

QUERIES: dict = {}
ORACLES: dict[str, str] = {"op2_host_rules": sql.HOST_RULES, "op8_suffix_dedup": sql.SUFFIX_DEDUP, "op11_periodic_runs": sql.PERIODIC_RUNS, "op12_circulant_minhash": sql.CIRCULANT_MINHASH, "op13_filter_audit": sql.FILTER_AUDIT}


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_url_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")


@query
def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return host_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"),
    )


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = encode_texts(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return both.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, base),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = read_media(store_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return media.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.format_string("%dx%d:%08x", "width", "height", F.crc32("rgb")).alias("feature"),
    )


def packed(docs: DataFrame) -> DataFrame:
    pieces = token_pieces(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, SEQUENCE)
    return pack(pieces, SEQUENCE).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@query
def op10_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model).select(
        "doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


@query
def op6_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def replayed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which every document with h % 10 = 0, h = crc32(decimal doc_id), repeats from its word g % n on what follows there, g = h div 10."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    parts = docs.select("doc_id", "text", F.expr("crc32(CAST(doc_id AS string)) DIV 10").alias("g"), words.alias("words")).select("*", F.size("words").alias("n"))
    placed = parts.select("*", (F.col("g") % F.greatest("n", F.lit(1))).cast("int").alias("a"))
    period = placed.select("*", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS int)").alias("p"))
    again = F.flatten(F.array_repeat(F.expr("slice(words, a + 1, p)"), F.ceil(F.col("n") / F.col("p")).cast("int")))
    ws = F.concat(F.expr("slice(words, 1, a)"), F.slice(again, F.lit(1), F.col("n") - F.col("a")))
    return period.select("doc_id", F.when(F.col("n") > 0, F.array_join(ws, " ")).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(replayed(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_sort("runs", lambda x, y: F.coalesce(*[F.when(a < b, -1).when(a > b, 1) for a, b in ((y["length"], x["length"]), (x["start"], y["start"]), (x["period"], y["period"]))], F.lit(0)))
    listed = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    longest = F.get(best, F.lit(0))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), longest.alias("best"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


@query
def op12_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_sets(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = failure_masks(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return interaction_audit(masks, table(spark, sf_dir, "labels"))
