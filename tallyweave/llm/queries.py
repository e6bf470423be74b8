"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontaminate, jaccard, mainhtml, mixing, periods, quality, repeats, substrings, tokens, toxicity, urls
from .runtime import fresh_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), num=9, den=10, k=3)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-files")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1, apart=True, lower=True)
    read = tokens.read_tokens(spark, path)
    return read.select("doc_id", "start", "n_tokens", tokens.ids_crc32("tokens").alias("ids_crc32"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    formatted = written(chat.format_chats(rows.unionByName(own)), "chats")
    return chat.conversation_digests(formatted)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.trained(urls.labelled_urls(spark))
    rows, n = urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), model, URL_RULES)
    return rows.select("page_id", *[F.col(n[c]).alias(c) for c in ("host", "path", "rule", "verdict")])


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = mainhtml.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats.repeats(table(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    digests = written(got.texts.select("key", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")), "repeat-digests")
    spark.sql(f"drop table {got.table}")
    return got.documents.join(digests, "key").drop("key").withColumn("has_repeats", F.col("n_spans") > 0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = substrings.Cover(length=13)
    got = substrings.shared_words(table(spark, sf_dir, "documents"), cover=cover)
    digests = written(got.texts.select("key", "first", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "word-digests")
    spark.sql(f"drop table {got.table}")
    return substrings.of_rows(got.documents, digests, cover.length, {"kept_sha256": F.sha2(F.lit(""), 256)})


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = codes.compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = codes.label_errors(got.rows.drop("embedding"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(codes.books_sha256(got.books)).alias("codebooks_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periods.periodic_runs(docs.select("doc_id", periods.tail_repeated(F.col("doc_id"), F.col("text")).alias("text")))
    best = periods.longest_run(F.col("runs"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(periods.runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_token_output, op3_toxicity, op4_url_filters, op5_benchmark_decontamination, op6_html_extraction, op7_source_mixing, op8_suffix_dedup, op9_quality_rules, op10_chat_formatting, op11_substring_dedup, op12_vector_codes, op13_periodic_runs)}
SQL: dict[str, str] = {"op5_benchmark_decontamination": decontaminate.SQL, "op7_source_mixing": mixing.sql(), "op10_chat_formatting": chat.SQL, "op11_substring_dedup": substrings.SQL, "op12_vector_codes": codes.SQL}
