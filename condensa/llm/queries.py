"""The registered queries of this package. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from condensa.llm import (
    bitplanes,
    bpe,
    brown,
    classifier,
    itq,
    packing,
    preference,
    quality_rules,
    repair,
    runs,
    simhash,
    token_counts,
    toxicity,
)
from condensa.functions.text import bind
from condensa.llm.common import remainder, words
from condensa.session import new_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = remainder("doc_id", 4) != 2
    scored = classifier.classify(documents(spark, sf_dir), labels, learn)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return scored.withColumn("held_out", held_out)


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def _span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), " ")


@query
def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with a stale last reply.

    Conversations over the bound of a row are a row for each turn, with its `place`; else that is null.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return preference.stale_reply_preferences(turns).select(
        "conv_id", "n_common", "prompt", "chosen_text",
        _span_text("chosen_spans").alias("chosen_spans"),
        "rejected_text", _span_text("rejected_spans").alias("rejected_spans"), "place",
    )


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.roundtrip_digests(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Of the labelled documents whose remainder mod 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.train(docs, labels, remainder("doc_id", 3) != 1)


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_model(docs, spark, sf_dir))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return scored.withColumn("held_out", held_out)


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(documents(spark, sf_dir), tokenizer, public_tokenizers.PATTERN)


@query
def op7_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = new_path(spark, "token-ids")
    bitplanes.write_ids(documents(spark, sf_dir), tokenizer, path)
    return bitplanes.read_documents(spark, path)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark, sf_dir)
    return token_counts.token_counts(docs, tokenizer, public_tokenizers.PATTERN)


@query
def op9_itq_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = quality_rules.quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return result.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def _with_period(text: Column, key: str, found: Column) -> Column:
    """The words, those from some place on replaced by a period of them, joined by one space."""
    g = F.floor(F.crc32(F.col(key).cast("string").cast("binary")) / 10)
    n = F.size(found)

    def repeated(w: Column) -> Column:
        a = (g % F.size(w)).cast("int")
        p = (1 + F.floor((F.size(w) - a) / (3 + g % 8))).cast("int")
        return bind(
            F.struct(a.alias("a"), p.alias("p")),
            lambda at: F.transform(
                w,
                lambda word, i: F.when(i < at["a"], word).otherwise(
                    F.get(w, at["a"] + (i - at["a"]) % at["p"])
                ),
            ),
        )

    return F.when(n > 0, F.array_join(bind(found, repeated), " ")).otherwise(text)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Documents in which every tenth, by the checksum of its key, has a periodic end."""
    chosen = remainder("doc_id", 10) == 0
    planted = F.when(chosen, _with_period(F.col("text"), "doc_id", words(F.col("text"))))
    return docs.select("doc_id", F.coalesce(planted, "text").alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_planted_periods(documents(spark, sf_dir)))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    # the longest; of those the first, of those the one of the shortest period
    order = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("run")))
    longest = found.withColumn("longest", F.array_max(order)["run"])
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, without end marks, repeated or of another role, by their checksum."""
    blank = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    drawn = turns.withColumn("draw", F.crc32(name.cast("binary")) % 20).where("draw <> 0")
    text = F.coalesce("text", blank)
    changed = (
        F.when(F.col("draw") == 1, "")
        .when(F.col("draw") == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
    )
    role = F.when(F.col("draw") == 4, "user").otherwise(F.coalesce("role", blank))
    times = F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1))
    rows = drawn.select("conv_id", "turn", role.alias("role"), changed.alias("text"), F.explode(times).alias("copy"))
    return rows.drop("copy")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair.conversations(repair.repair(damaged_turns(turns)))
    every = turns.select(F.col("conv_id").alias("own")).distinct()
    met = every.join(found, F.col("own").eqNullSafe(F.col("conv_id")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return met.select(
        F.col("own").alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query
def op13_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = remainder("doc_id", 10)
    scored = brown.class_scores(documents(spark, sf_dir), drawn != 0)
    return scored.withColumn("held_out", F.coalesce(remainder("doc_id", 10) == 0, F.lit(False)))
