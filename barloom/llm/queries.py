"""Queries of the operators over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest, frames, html, leaks, licenses, lines, packing, repeats, ring, runs, secrets, vantage, whitening
from . import sql
from .common import table, texts, words

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_suffix_repeats")
def op1_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove(table(spark, folder, "documents")).drop("kept")


@query("op2_text_density")
def op2_text_density(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


@query("op3_minhash_containment", sql.LEAKS)
def op3_minhash_containment(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op4_ring_shards")
def op4_ring_shards(spark: SparkSession, folder: str) -> DataFrame:
    return ring.shard(table(spark, folder, "documents"))


@query("op5_markov_secrets")
def op5_markov_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets.digest(secrets.scan(docs, secrets.train(docs, table(spark, folder, "labels"))))


@query("op6_lsh_forest")
def op6_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.near_duplicates(table(spark, folder, "documents"))


@query("op7_line_rules", sql.LINES)
def op7_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return lines.rate(table(spark, folder, "documents")).drop("row", "clean_text")


@query("op8_diagonal_licenses")
def op8_diagonal_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json")))


@query("op10_token_frames")
def op10_token_frames(spark: SparkSession, folder: str) -> DataFrame:
    manifest = frames.write_frames(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), frames.fresh_folder(spark))
    return frames.read_frames(manifest)


@query("op11_vantage_points")
def op11_vantage_points(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return vantage.search(vantage.index(rows), rows.where("vec_id % 100 = 0"))


def with_periods(docs: DataFrame) -> DataFrame:
    """Every tenth text by the checksum h of its doc_id repeats, from word g % n on, the words of one period (g: h / 10)."""
    out = texts(docs).withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    out = out.withColumn("_w", F.when(F.col("_h") % 10 == 0, words(F.col("text"))))
    out = out.withColumn("_n", F.size("_w")).withColumn("_g", F.expr("_h div 10"))
    out = out.withColumn("_a", F.expr("CASE WHEN _n > 0 THEN _g % _n END"))
    out = out.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    return out.select("doc_id", F.expr("""CASE WHEN _h % 10 = 0 AND _n > 0 THEN concat_ws(' ', transform(sequence(0, _n - 1),
        i -> element_at(_w, cast(1 + if(i < _a, i, _a + (i - _a) % _p) AS int)))) ELSE text END""").alias("text"))


@query("op12_grammar_runs")
def op12_grammar_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.digest(runs.find(with_periods(table(spark, folder, "documents"))))


@query("op13_chebyshev_whitening")
def op13_chebyshev_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))
