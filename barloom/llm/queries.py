"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, decontamination, html_blocks, language, mixing, near_duplicates, periodic_runs, quality, secrets, sharding, spelling, topk, warc
from .common import let, table, words


def op1_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.brown_scores(table(spark, sf_dir, "documents"))


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.ledger(table(spark, sf_dir, "documents"))
    base = F.col("failed").bitwiseAND(F.lit(quality.BASE)) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality.verdict("v3").alias("kept"), "failed")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, over the ledger of all documents."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return language.identify(docs.select("doc_id", "text"), learn_from=docs).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return placed.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def _planted(doc_id: Column, text: Column) -> Column:
    """text with the repeats that op11's contract plants: from word a on, words repeat with period p. Documents with crc32(doc_id) % 10 = 0."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        part = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        again = F.flatten(F.array_repeat(part, (F.floor((n - a) / p) + 1).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a.cast("int")), again), F.lit(1), n.cast("int")), " ")

    return F.when(h % 10 == 0, let(words(text), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text))).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.find_runs(docs)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("top.start"), F.col("top.length"), -F.col("top.period")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs_of_letters(table(spark, sf_dir, "documents").select("doc_id", "text")).where(F.length("run") >= 5)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    deleted = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return spelling.variants(runs.select(F.when(h % 97 == 0, deleted).otherwise(F.col("run")).alias("word")))


def op13_top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (op1_brown_scores, op2_quality_ledger, op3_source_mix, op4_decontamination, op5_language, op6_secrets, op7_warc, op8_html_text, op9_shards, op10_near_duplicates, op11_periodic_runs, op12_spelling_variants, op13_top_vectors, quality_ablations)
}
