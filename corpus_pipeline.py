"""The corpus pipeline: a table of documents goes through five stages, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it as Parquet to the
shared folder and reads it again as the next stage's documents. All but the last return the columns
of their input, with extra columns of any name. Null texts count as empty, missing ids and repeated
rows are allowed everywhere (the operators say what becomes of them), texts of any length go through
whole, and an empty table gives an empty result. Ties do not depend on the order of rows: languages
with one score go by the network's order, the smallest id of a group of similar documents stays, and
the mix goes by a hash of the row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, linededup, mixing, ngramjoin, pieces
from millrace.llm.text import words
from millrace.util import col, fresh, written

# What a text's language must be predicted with. A text in two languages has half for each and stays.
LEAST_SCORE = 0.35
VOCABULARY = "piece_bpe_32k.model"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that stands out, go.

    The network learns from the text and language of documents that are not held out.
    """
    net = langid.fit(docs.where(~langid.is_held_out(F.col("doc_id"))))
    language, score = fresh(docs, "_lang"), fresh(docs, "_score")
    judged = langid.predict(docs, net, language=language, score=score)
    known = (F.col(language) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)
    return judged.where(known).select(*docs.columns)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go, in every document."""
    cleaned = linededup.dedup_lines(docs, least_docs=10)
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their 5-word shingles, one stays."""
    return ngramjoin.one_of_each(docs, k=5, percent=80).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their targets: a document is there as often as the mix takes it.

    The document at a source's cut is there with its first words only, so that the budget is met
    exactly.
    """
    key, got, size = (fresh(docs, c) for c in ("_key", "_taken", "_size"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "source", "text"))
    sized = keyed.select(key, "source", F.size(words(F.col("text"))).alias("size"))
    taken = (mixing.mix(sized, key, "source", "size").groupBy(F.col("id").alias(key))
             .agg(F.sum("taken").alias(got), F.max("size").alias(size)).where(F.col(got) > 0))
    # Rows that repeat are one row here, with the words that all of them give.
    chosen = keyed.dropDuplicates([key]).join(taken, key)
    whole = F.floor(F.col(got) / F.col(size))
    rest = (F.col(got) % F.col(size)).cast("int")
    head = F.array_join(F.slice(words(F.col("text")), F.lit(1), rest), " ")
    texts = F.concat(F.array_repeat(F.col("text"), whole.cast("int")),
                     F.when(rest > 0, F.array(head)).otherwise(F.array().cast("array<string>")))
    others = [col(c) for c in docs.columns if c not in ("text", "n_chars")]
    out = chosen.select(*others, F.explode(texts).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text, and whether they decode to it again."""
    path = public_tokenizers.path(VOCABULARY)
    coded = pieces.encode(docs.select("doc_id", "source", "text"), path, decoded="decoded")
    return coded.select(
        "doc_id", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_frequent_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

# A trained network and a search for the best pieces cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
