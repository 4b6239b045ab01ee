"""Encode all documents into pieces and decode them again."""

import public_tokenizers
from pyspark.sql import functions as F

from millrace.llm import pieces
from millrace.llm.plans import query, table

MODEL = "piece_bpe_32k.model"


@query("op9_sentencepiece")
def op9_sentencepiece(spark, folder):
    path = public_tokenizers.path(MODEL)
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return pieces.encode(documents, path, decoded="decoded").select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
