"""Encode all documents into grammar-compressed files and read them back."""

import public_tokenizers

from millrace.llm import grammar
from millrace.llm.plans import query, table
from millrace.util import scratch


@query("op4_repair_tokens")
def op4_repair_tokens(spark, folder):
    root = scratch(spark, "tokens")
    grammar.write_tokens(table(spark, folder, "documents"), root,
                         public_tokenizers.path("word_bpe_49k.json"))
    return grammar.read_tokens(spark, root).select("doc_id", "start", "n_tokens", "ids_crc32")
