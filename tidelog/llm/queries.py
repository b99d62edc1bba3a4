"""One query an operator, over its whole table, with production parameters; SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontaminate, html_extract, license_scan, ngram_join, ngram_lm, packing, pii, quality_rules, substring_dedup, twins, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query(twins.SUBSTRING_DEDUP)
def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), keep_text=False)


@query()
def op2_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query(twins.QUALITY_RULES)
def op3_quality_rules(spark, sf_dir):
    d = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


@query(twins.WARC)
def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


@query()
def op5_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query()
def op6_ngram_lm(spark, sf_dir):
    return ngram_lm.score(table(spark, sf_dir, "documents"))


@query()
def op7_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(twins.NGRAM_JOIN)
def op8_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query(twins.HTML_EXTRACT)
def op9_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query()
def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
