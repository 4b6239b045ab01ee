"""The number of tokens of all documents."""

import public_tokenizers

from millrace.llm import tokencounts
from millrace.llm.plans import query, table


@query("op11_token_counts")
def op11_token_counts(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    judged = tokencounts.judge_lengths(documents, public_tokenizers.path("byte_bpe_50k.json"))
    return judged.select("doc_id", "n_bytes", "n_tokens", "over_limit")
