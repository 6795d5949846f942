"""The registered queries. Each takes (spark, sf_dir) and returns a DataFrame.

Arrays and maps are returned as strings, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from condensa.functions import ids as I, text as T
from condensa.operators import (
    align,
    beam,
    encode,
    lattice,
    lm,
    pointer,
    rouge,
    sample,
    sketch,
    stats,
    subword,
    summarize,
)
from condensa.operators.decode import decode_words
from condensa.operators.vocab import load_vocab, save_vocab
from condensa.plans import inputs as P
from condensa.plans.evaluate import Evaluation, evaluate
from condensa.session import materialize, new_path
from condensa.sources import articles, examples as example_files, report
from condensa.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def joined(array: str | Column) -> Column:
    return F.array_join(array, " ")


def oov_text(oov: str = "oov") -> Column:
    entries = F.map_entries(oov)
    return joined(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])))


def example_text(examples: DataFrame, key: str = "doc_id") -> DataFrame:
    return examples.select(
        key, joined("x").alias("x"), joined("y").alias("y"), "oov_cnt", oov_text().alias("oov")
    )


# --- text functions -------------------------------------------------------------------


@query
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.documents(spark, sf_dir).select("doc_id", joined(T.word_tokens("text")).alias("tokens"))


@query
def tokenize_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.documents(spark, sf_dir)
    return docs.select("doc_id", joined(T.plain_tokens("text")).alias("tokens"))


@query
def clean_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.documents(spark, sf_dir).select("doc_id", T.clean_chars("text").alias("cleaned"))


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", T.normalize_text("text").alias("normalized"))


def _sentence_rows(docs: DataFrame, pieces: Column) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode_outer(pieces).alias("pos", "sentence"))
    return rows.where("sentence IS NOT NULL")


@query
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = T.split_sentences(T.flatten_newlines("text"))
    return _sentence_rows(P.documents(spark, sf_dir), pieces)


@query
def split_sentences_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = T.split_sentences(T.flatten_newlines("text"), upper="unicode")
    return _sentence_rows(P.documents(spark, sf_dir), pieces)


@query
def sentence_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text files of all documents, read back."""
    path = new_path(spark, "sentences")
    articles.write_sentences(P.documents(spark, sf_dir), path)
    return articles.read_lines(spark, path)


@query
def sentence_corpus_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the head cut: the first half of the documents."""
    path = new_path(spark, "sentences")
    articles.write_sentences(P.documents(spark, sf_dir), path, proportion=0.5)
    return articles.read_lines(spark, path)


@query
def detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.documents(spark, sf_dir)
    return docs.select("doc_id", T.detokenize(T.word_tokens("text")).alias("fixed"))


@query
def detokenize_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts, cut at white space."""
    docs = P.documents(spark, sf_dir)
    return docs.select("doc_id", T.detokenize_text("text").alias("fixed"))


# --- vocabulary -----------------------------------------------------------------------


@query
def build_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.vocabulary(P.documents(spark, sf_dir))


@query
def vocab_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary file, read back."""
    path = new_path(spark, "vocab")
    docs = P.documents(spark, sf_dir)
    save_vocab(P.vocabulary(docs), path)
    return load_vocab(spark, path)


# --- encoding -------------------------------------------------------------------------


@query
def encode_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example_text(P.examples(P.documents(spark, sf_dir)))


@query
def encode_examples_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result by the way for vocabularies too large for an inline table."""
    docs = P.documents(spark, sf_dir)
    return example_text(
        encode.encode_examples(
            P.doc_pairs(docs),
            P.vocabulary(docs),
            P.VOCAB_SIZE,
            P.TX,
            P.TY,
            P.MAX_OOV,
            lookup="join",
        )
    )


@query
def encode_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result from article files picked up by an incremental run."""
    docs = P.documents(spark, sf_dir)
    source, out = new_path(spark, "new-articles"), new_path(spark, "encoded")
    articles.write_articles(P.doc_pairs(docs), source)
    run = incremental.encode_new_articles(
        incremental.article_stream(spark, source, ["source", "target"], "doc_id", LongType()),
        P.written_vocabulary(docs),
        P.VOCAB_SIZE,
        P.TX,
        P.TY,
        P.MAX_OOV,
        out,
        new_path(spark, "progress"),
    )
    run.awaitTermination()
    return example_text(example_files.read_examples(spark, out))


@query
def encode_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = P.vocabulary(P.documents(spark, sf_dir))
    pairs = P.turn_pairs(spark, sf_dir)
    encoded = encode.encode_examples(
        pairs, vocab, P.VOCAB_SIZE, P.TX, P.TY, P.MAX_OOV, key="ex_id"
    )
    return example_text(encoded, "ex_id")


def _half_empty_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn pairs with some sources and some targets null, and one key for all."""
    pairs = P.turn_pairs(spark, sf_dir)
    draw = F.md5("ex_id")
    return pairs.select(
        F.lit("same").alias("ex_id"),
        F.when(F.substring(draw, 1, 1) >= "5", F.col("source")).alias("source"),
        F.when(F.substring(draw, 2, 1) >= "4", F.col("target")).alias("target"),
    )


def _encoded_half_empty(spark: SparkSession, sf_dir: str, lookup: str) -> DataFrame:
    vocab = P.written_vocabulary(P.documents(spark, sf_dir))
    pairs = _half_empty_turns(spark, sf_dir)
    encoded = encode.encode_examples(
        pairs, vocab, P.VOCAB_SIZE, P.TX, P.TY, P.MAX_OOV, key="ex_id", lookup=lookup
    )
    return example_text(encoded, "ex_id")


@query
def encode_missing_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and repeated keys, by the inline way."""
    return _encoded_half_empty(spark, sf_dir, "inline")


@query
def encode_missing_sides_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and repeated keys, by the join way."""
    return _encoded_half_empty(spark, sf_dir, "join")


@query
def oov_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.oov_rows(P.examples(P.documents(spark, sf_dir)))


@query
def teacher_forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    collapsed = I.collapse_unknown("y", P.VOCAB_SIZE)
    examples = P.examples(P.documents(spark, sf_dir))
    return examples.select("doc_id", joined(collapsed).alias("y_in"))


@query
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = P.doc_pairs(P.documents(spark, sf_dir)).select(
        "doc_id",
        F.size(T.word_tokens("source")).alias("x_len"),
        F.size(T.word_tokens("target")).alias("y_len"),
    )
    return encode.length_filter(sized, F.col("x_len"), F.col("y_len"), P.CUTOFF, P.TY)


@query
def id_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.id_range_check(P.examples(P.documents(spark, sf_dir)))


# --- files ----------------------------------------------------------------------------


@query
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "articles")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    articles.write_articles(docs, path)
    return articles.read_articles(spark, path, ["text", "lang"], "doc_id", LongType())


def _split_lines(spark: SparkSession, sf_dir: str) -> articles.SplitArticles:
    """Documents as JSON lines, some cut off and some without an id, read back."""
    path, docs = new_path(spark, "lines"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    draw, digest = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1), F.md5("text")
    line = (
        F.when(draw == "0", F.concat(F.lit('{"doc_id": '), "doc_id", F.lit(', "text": "'), digest))
        .when(draw == "1", F.concat(F.lit('{"text": "'), digest, F.lit('"}')))
        .when(draw == "2", F.concat(F.lit('{"doc_id": "'), digest, F.lit('", "text": "x"}')))
        .otherwise(F.to_json(F.struct("doc_id", "text")))
    )
    docs.select(line.alias("value")).write.text(path)
    return articles.split_articles(spark, path, ["text"], "doc_id", LongType())


@query
def articles_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_lines(spark, sf_dir).good


@query
def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that are no articles; where they stand depends on the files."""
    return _split_lines(spark, sf_dir).bad.select("value", "reason")


@query
def normalized_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "normalized")
    articles.write_normalized_csv(
        P.doc_pairs(P.documents(spark, sf_dir)), ["source", "target"], path
    )
    return articles.read_normalized_csv(spark, path, ["source", "target"])


@query
def ragged_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ragged")
    example_files.write_examples_csv(P.examples(P.documents(spark, sf_dir)), path)
    read = example_files.read_examples_csv(spark, path, P.TX, P.TY, P.MAX_OOV)
    return read.select(
        joined("x").alias("x"), joined("y").alias("y"), "oov_cnt", oov_text().alias("oov")
    )


@query
def examples_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "examples")
    example_files.write_examples(P.examples(P.documents(spark, sf_dir)), path)
    return example_text(example_files.read_examples(spark, path))


# --- decoding -------------------------------------------------------------------------


def _decoded(spark: SparkSession, sf_dir: str, lookup: str) -> DataFrame:
    docs = P.documents(spark, sf_dir)
    vocab = P.written_vocabulary(docs)
    return decode_words(
        P.examples(docs, vocab),
        vocab,
        P.VOCAB_SIZE,
        {"x": "source_text", "y": "target_text"},
        remove_paddings=True,
        remove_eos=True,
        lookup=lookup,
    )


@query
def decode_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "inline")


@query
def decode_examples_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "join")


@query
def real_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that are not padding."""
    return P.examples(P.documents(spark, sf_dir)).select(
        "doc_id",
        F.size(I.real_ids("x")).alias("x_real"),
        F.size(I.real_ids("y")).alias("y_real"),
    )


# --- statistics -----------------------------------------------------------------------


def _length_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(P.documents(spark, sf_dir), F.size(T.word_tokens("text")))


@query
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_summary(_length_counts(spark, sf_dir))


@query
def length_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths by stored sketches: half of the files first, the others added; errors against exact counts."""
    docs, folder, store = P.documents(spark, sf_dir), new_path(spark, "texts"), new_path(spark, "sketches")
    length = F.size(T.word_tokens("text"))
    for part in (0, 1):
        own = docs.where(F.pmod("doc_id", F.lit(2)) == part)
        own.repartition(4, "doc_id").write.mode("append").parquet(folder)
        sketch.add_files(spark, folder, store, length)
    summary = sketch.merged_summary(sketch.read_store(spark, store))
    errors = sketch.rank_errors(summary, stats.value_counts(docs, length))
    within = [(F.col(f"error_{i}") <= sketch.RANK_ERROR).alias(f"q{i}_within") for i in (1, 2, 3)]
    return errors.select("n", "min_value", "max_value", *within)


@query
def cutoff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cutoff_report(_length_counts(spark, sf_dir), P.CUTOFF)


@query
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_length_counts(spark, sf_dir))


@query
def excess_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(stats.excess_counts(_length_counts(spark, sf_dir), P.CUTOFF))


@query
def oov_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stats.value_counts(P.examples(P.documents(spark, sf_dir)), F.col("oov_cnt"))
    return stats.distribution_report(counts, P.MAX_OOV // 2)


# --- batches and samples --------------------------------------------------------------


@query
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return sample.batches(docs, "doc_id", P.BATCH_SIZE)


@query
def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in the order of an epoch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return sample.epoch_batches(docs, "doc_id", P.BATCH_SIZE, P.SEED, P.EPOCH)


def _turn_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("turn_key"), "role")


@query
def turn_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in the order of a string key."""
    return sample.batches(_turn_keys(spark, sf_dir), "turn_key", P.BATCH_SIZE)


@query
def turn_head_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head cut by a string key."""
    return sample.head_fraction(_turn_keys(spark, sf_dir), "turn_key", 0.3)


@query
def head_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return sample.head_fraction(docs, "doc_id", 0.3)


@query
def evaluated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many whole batches as the documents fill, in key order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return sample.evaluated_rows(docs, "doc_id", P.BATCH_SIZE, None, P.SAMPLES)


@query
def eval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of the documents, with their texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    drawn = sample.random_sample(docs, "doc_id", P.SAMPLES, P.SEED)
    return docs.join(F.broadcast(drawn), "doc_id", "left_semi")


# --- summaries and their evaluation ---------------------------------------------------


@query
def lead_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize.lead_k(P.documents(spark, sf_dir), P.SUMMARY_SENTENCES)


@query
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize.extractive_summary(P.documents(spark, sf_dir), P.SUMMARY_SENTENCES)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query
def rouge_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rouge.rouge_n(P.lead_pairs(P.documents(spark, sf_dir)), 1), "r", "p", "f")


@query
def rouge_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rouge.rouge_n(P.lead_pairs(P.documents(spark, sf_dir)), 2), "r", "p", "f")


@query
def rouge_2_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = P.lead_pairs(P.documents(spark, sf_dir))
    return _rounded(rouge.rouge_n(pairs, 2, counting="set"), "r", "p", "f")


@query
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rouge.rouge_l(P.lead_pairs(P.documents(spark, sf_dir))), "r", "p", "f")


@query
def rouge_l_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id arrays: the encoded first source sentence against the encoded target."""
    docs = P.documents(spark, sf_dir)
    pairs, vocab = P.doc_pairs(docs), P.written_vocabulary(docs)
    first = F.get(T.split_sentences("source"), F.lit(0))

    def ids(df: DataFrame, name: str) -> DataFrame:
        encoded = encode.encode_examples(df, vocab, P.VOCAB_SIZE, P.TX, P.TY, P.MAX_OOV)
        return encoded.select("doc_id", F.col("y").alias(name))

    refs = ids(pairs, "ref")
    preds = ids(pairs.withColumn("target", first), "pred")
    return _rounded(rouge.rouge_l_ids(rouge.joined_pairs(preds, refs)), "r", "p", "f")


@query
def rouge_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = P.lead_pairs(P.documents(spark, sf_dir))
    return _rounded(rouge.averages(rouge.all_scores(pairs)), "r", "p", "f")


def _evaluation(spark: SparkSession, sf_dir: str) -> Evaluation:
    """All examples, with the first sentence of the source as the prediction."""
    docs = P.documents(spark, sf_dir)
    vocab = P.written_vocabulary(docs)
    first = F.get(T.split_sentences("source"), F.lit(0))
    cut = F.array_join(F.slice(T.word_tokens(first), 1, P.TY - 1), " ")  # as a target is cut
    predictions = P.doc_pairs(docs).select("doc_id", cut.alias("pred_summary"))
    return evaluate(
        P.examples(docs, vocab), predictions, vocab, P.VOCAB_SIZE, P.SAMPLES, P.SEED
    )


@query
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation job on all examples: sampled triples next to the average scores."""
    result = _evaluation(spark, sf_dir)
    names = {"rouge-1": "rouge_1_f", "rouge-2": "rouge_2_f", "rouge-l": "rouge_l_f"}
    by_metric = F.map_from_entries(F.collect_list(F.struct("metric", "f")))
    scores = result.averages.agg(by_metric).scalar()
    with_scores = result.samples.withColumn("scores", scores).select(
        *result.samples.columns,
        *[F.element_at("scores", F.lit(m)).alias(name) for m, name in names.items()],
    )
    return _rounded(with_scores, *names.values())


def _report_row(result: Evaluation) -> DataFrame:
    """The averages in one row, with the number of samples."""
    names = [(m, c, f"{m.replace('-', '_')}_{c}") for m in rouge.METRICS for c in rouge.MEASURES]
    scores = [
        F.round(F.max(F.when(F.col("metric") == m, F.col(c))), 6).alias(name) for m, c, name in names
    ]
    n = result.samples.agg(F.count("*")).scalar().cast("int")
    return result.averages.agg(*scores).withColumn("saved_summaries", n)


@query
def evaluate_exchange_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the exchange file to scores: rows keyed by position, predictions as ids.

    The prediction of a row is its own source, cut as a target is; some rows have none.
    """
    docs = P.documents(spark, sf_dir)
    vocab = P.written_vocabulary(docs)
    path = new_path(spark, "exchange")
    example_files.write_examples_csv(P.examples(docs, vocab), path)
    read = example_files.read_examples_csv(spark, path, P.TX, P.TY, P.MAX_OOV, key="row")
    # the position depends on the files, so the rows without a prediction are told by their ids
    given = F.substring(F.md5(joined("x")), 1, 1) >= "3"
    predictions = read.where(given).select("row", F.slice("x", 1, P.TY - 1).alias("pred_ids"))
    result = evaluate(read, predictions, vocab, P.VOCAB_SIZE, P.SAMPLES, P.SEED, key="row")
    return _report_row(result)


@query
def evaluate_first_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extractive summaries as predictions, scored on the first whole batches."""
    docs = P.documents(spark, sf_dir)
    vocab = P.written_vocabulary(docs)
    summaries = summarize.extractive_summary(docs, P.SUMMARY_SENTENCES)
    cut = F.array_join(F.slice(T.word_tokens("summary"), 1, P.TY - 1), " ")
    examples = materialize(P.examples(docs, vocab), "examples")
    whole = (examples.count() - 1) // P.BATCH_SIZE
    result = evaluate(
        examples,
        summaries.select("doc_id", cut.alias("pred_summary")),
        vocab,
        P.VOCAB_SIZE,
        P.SAMPLES,
        P.SEED,
        batch_size=P.BATCH_SIZE,
        total_batches=whole,
    )
    return _report_row(result)


@query
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report file of the evaluation job, read back and taken apart."""
    result, path = _evaluation(spark, sf_dir), new_path(spark, "report")
    config = {"vocab_size": P.VOCAB_SIZE, "Tx": P.TX, "Ty": P.TY, "saved_summaries": P.SAMPLES}
    report.write_report(result.averages, result.samples, config, path)
    line = spark.read.text(path)
    scores = [
        F.round(F.get_json_object("value", f"$[0].{metric}.{m}").cast("double"), 6).alias(
            f"{metric.replace('-', '_')}_{m}"
        )
        for metric in ("rouge-1", "rouge-2", "rouge-l")
        for m in rouge.MEASURES
    ]
    first = [
        F.get_json_object("value", f"$[2].{field}").alias(f"first_{field}")
        for field in ("text", "ref_summary", "pred_summary")
    ]
    return line.select(
        *scores,
        F.get_json_object("value", "$[1].vocab_size").cast("int").alias("vocab_size"),
        (F.json_array_length("value") - 2).alias("saved_summaries"),
        *first,
    )


# --- corpus tables --------------------------------------------------------------------


@query
def copy_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lm.copy_distribution(P.examples(P.documents(spark, sf_dir))), "p")


def _aligned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Numbered examples, their pairs of ids, the aligned table and its likelihoods."""
    rows = align.numbered(P.examples(P.documents(spark, sf_dir)))
    pairs = materialize(align.id_pairs(rows, P.VOCAB_SIZE), "id-pairs")
    return rows, pairs, *align.align(pairs, P.ALIGNMENT_ROUNDS)


@query
def alignment_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_aligned(spark, sf_dir)[3], "log_likelihood", digits=2)


@query
def alignment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_aligned(spark, sf_dir)[2], "p")


@query
def copy_distribution_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy distribution with the weights that the alignment gives to the source."""
    rows, pairs, table, _ = _aligned(spark, sf_dir)
    weighted = align.aligned_weights(rows, pairs, table, P.VOCAB_SIZE)
    return _rounded(lm.copy_distribution(weighted, weights="weights"), "p")


def _with_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Examples, read twice, and the corpus distribution of their targets."""
    examples = materialize(P.examples(P.documents(spark, sf_dir)), "examples")
    return examples, lm.corpus_distribution(examples, P.VOCAB_SIZE)


@query
def corpus_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = P.examples(P.documents(spark, sf_dir))
    return _rounded(lm.corpus_distribution(examples, P.VOCAB_SIZE), "p", digits=9)


@query
def mixed_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = lm.token_probabilities(*_with_corpus(spark, sf_dir), P.VOCAB_SIZE, P.P_GEN)
    rows = probs.select("doc_id", F.inline("probs"))
    return _rounded(rows, "p_corpus", "p_copy", "p_final")


@query
def mixture_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    nll = lm.mixture_nll(*_with_corpus(spark, sf_dir), P.VOCAB_SIZE, P.P_GEN)
    return _rounded(nll, "nll")


@query
def mixture_nll_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the way for vocabularies too large for an inline table."""
    examples, corpus = _with_corpus(spark, sf_dir)
    return _rounded(lm.mixture_nll(examples, corpus, P.VOCAB_SIZE, P.P_GEN, lookup="join"), "nll")


@query
def masked_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the examples of the mean id at the target's real positions."""
    examples = P.examples(P.documents(spark, sf_dir))
    mask = F.transform("y", lambda i: i != I.PAD)
    averaged = lm.masked_average(examples.withColumn("mask", mask), "y", "mask")
    return _rounded(averaged, "masked_average", digits=4)


@query
def coverage_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lm.coverage_repetition(P.documents(spark, sf_dir)), "penalty")


@query
def bigram_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lm.bigram_counts(
        P.documents(spark, sf_dir), T.word_tokens("text"), F.lit("<sos>"), F.lit("<eos>")
    )
    return _rounded(lm.bigram_transitions(counts), "logp")


# --- path search ----------------------------------------------------------------------


def _starts_and_transitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document continued from its first token; transitions of the whole corpus."""
    docs = P.documents(spark, sf_dir)
    vocab = P.written_vocabulary(docs)
    ids = P.document_ids(docs, vocab)
    counts = lm.bigram_counts(ids, F.col("ids"), F.lit(I.SOS), F.lit(I.EOS))
    starts = materialize(P.document_starts(docs, vocab), "starts")
    return starts, lm.bigram_transitions(counts, bounded=True)


def _beam(spark: SparkSession, sf_dir: str, length_norm: str) -> DataFrame:
    starts, transitions = _starts_and_transitions(spark, sf_dir)
    found = beam.beam_search(
        starts,
        transitions,
        P.VOCAB_SIZE,
        bw=P.BEAM_WIDTH,
        max_len=P.PATH_LENGTH,
        length_norm=length_norm,
    )
    return _rounded(found.withColumn("seq", joined("seq")), "score")


def _pair_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, vocabulary, and how often an id follows an id, written."""
    docs = P.documents(spark, sf_dir)
    vocab = P.written_vocabulary(docs)
    ids = P.document_ids(docs, vocab)
    counts = lm.bigram_counts(ids, F.col("ids"), F.lit(I.SOS), F.lit(I.EOS))
    return docs, vocab, materialize(counts, "bigrams")


@query
def smoothed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _pair_counts(spark, sf_dir)[2]
    return _rounded(lm.smoothed_transitions(counts, P.DISCOUNT), "logp")


@query
def backoff_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each token leaves to unseen ones, and what all next tokens add up to: 1."""
    counts = _pair_counts(spark, sf_dir)[2]
    seen = lm.smoothed_transitions(counts, P.DISCOUNT).join(lm.continuation_shares(counts), "next")
    sums = seen.groupBy("prev").agg(F.sum(F.exp("logp")).alias("seen"), F.sum("p_next").alias("covered"))
    weights = lm.backoff_weights(counts, P.DISCOUNT).join(sums, "prev")
    total = F.col("seen") + F.col("backoff") * (1 - F.col("covered"))
    return _rounded(weights.select("prev", "total", "backoff", total.alias("sum")), "backoff", "sum")


@query
def beam_search_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any token may follow any other: unseen pairs are followed where they can be among the best."""
    docs, vocab, counts = _pair_counts(spark, sf_dir)
    starts = materialize(P.document_starts(docs, vocab), "starts")
    # a blocked unknown id and a first eos may take two places
    nexts = lm.smoothed_next_tokens(counts, P.DISCOUNT, P.BEAM_WIDTH + 3)
    found = beam.beam_search(starts, nexts, P.VOCAB_SIZE, bw=P.BEAM_WIDTH, max_len=P.SMOOTHED_LENGTH)
    return _rounded(found.withColumn("seq", joined("seq")), "score")


@query
def beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beam(spark, sf_dir, "divide")


@query
def beam_search_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beam(spark, sf_dir, "multiply")


@query
def greedy_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts, transitions = _starts_and_transitions(spark, sf_dir)
    found = beam.greedy_path(
        starts, transitions, P.VOCAB_SIZE, max_len=P.PATH_LENGTH, block_unk=True
    )
    return _rounded(found.withColumn("seq", joined("seq")), "logp")


def _pointer(spark: SparkSession, sf_dir: str, coverage: float, lookup: str) -> DataFrame:
    """Every document's best sequence through its own source, as ids and as text."""
    docs = P.documents(spark, sf_dir)
    vocab = P.written_vocabulary(docs)
    ids = P.document_ids(docs, vocab)
    counts = lm.bigram_counts(ids, F.col("ids"), F.lit(I.SOS), F.lit(I.EOS))
    examples = materialize(P.examples(docs, vocab), "examples")
    found = pointer.pointer_beam_search(
        examples,
        lm.bigram_transitions(counts, bounded=True),
        P.VOCAB_SIZE,
        P.P_GEN,
        I.SOS,
        bw=P.BEAM_WIDTH,
        max_len=P.POINTER_LENGTH,
        coverage=coverage,
        lookup=lookup,
    )
    with_words = found.join(examples.select("doc_id", "oov"), "doc_id")
    shown = decode_words(
        with_words, vocab, P.VOCAB_SIZE, {"seq": "text"}, remove_eos=True,
        keep=("seq", "score", "done", "n_finished"),
    )
    return _rounded(shown.withColumn("seq", joined("seq")), "score")


@query
def pointer_beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pointer(spark, sf_dir, 0.0, "inline")


@query
def pointer_beam_search_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the way for transitions too many for an inline table."""
    return _pointer(spark, sf_dir, 0.0, "join")


@query
def pointer_beam_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copying the same words again costs."""
    return _pointer(spark, sf_dir, P.COVERAGE, "inline")


# --- piece mode -----------------------------------------------------------------------


def _cleaned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.doc_pairs(P.documents(spark, sf_dir)).select(
        "doc_id", *[T.clean_chars(c).alias(c) for c in ("source", "target")]
    )


def _encoded_pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs as piece arrays, encoded, and the vocabulary of the pieces of their whole texts."""
    pairs = _cleaned_pairs(spark, sf_dir)
    vocab = P.piece_vocabulary(pairs)
    first = {"source": P.TX, "target": P.TY}
    cut = pairs.withColumns({c: subword.cut_pieces(c, P.PIECE_CHARS, n) for c, n in first.items()})
    return subword.encode_pieces(cut, vocab, P.VOCAB_SIZE, P.TX, P.TY, P.MAX_OOV), vocab


@query
def subword_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece arrays encoded as words are, with eos at the end of the source, too."""
    return example_text(_encoded_pieces(spark, sf_dir)[0])


@query
def subword_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """And back to text."""
    encoded, vocab = _encoded_pieces(spark, sf_dir)
    columns = {"x": "source_text", "y": "target_text"}
    return subword.decode_pieces(encoded, vocab, P.VOCAB_SIZE, columns)


@query
def merge_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each word, in one again where there are many."""
    docs = P.documents(spark, sf_dir)
    words = F.transform(T.plain_tokens("text"), lambda w: subword.cut_pieces(w, P.PIECE_CHARS))
    merged = F.flatten(F.transform(words, lambda p: subword.merge_fragments(p, 3)))
    return docs.select("doc_id", joined(merged).alias("pieces"))


def _scored_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cleaned pairs of texts, the counts of their words, and the table of pieces that those give."""
    pairs = _cleaned_pairs(spark, sf_dir)
    counts = materialize(lattice.marked_counts(pairs, ["source", "target"]), "piece-words")
    table = lattice.piece_scores(counts, P.PIECE_CHARS, P.VOCAB_WORDS)
    return pairs, counts, materialize(table, "piece-scores")


@query
def piece_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_table(spark, sf_dir)[2]


@query
def subword_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cut of each distinct word of the texts."""
    _, counts, table = _scored_table(spark, sf_dir)
    return lattice.cut_words(counts, table).withColumn("pieces", joined("pieces"))


def _encoded_scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs, _, table = _scored_table(spark, sf_dir)
    first = {"source": P.TX, "target": P.TY}
    cut = lattice.scored_pieces(pairs, ["source", "target"], table, first)
    return subword.encode_pieces(cut, table, P.VOCAB_SIZE, P.TX, P.TY, P.MAX_OOV), table


@query
def subword_encode_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut by the scored pieces, encoded; characters that are no piece are unknown words."""
    return example_text(_encoded_scored(spark, sf_dir)[0])


@query
def subword_decode_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, table = _encoded_scored(spark, sf_dir)
    columns = {"x": "source_text", "y": "target_text"}
    return subword.decode_pieces(encoded, table, P.VOCAB_SIZE, columns)
