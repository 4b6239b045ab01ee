"""Components of documents with similar sets of 4-word shingles."""

from pyspark.sql import functions as F

from millrace.llm import ngramjoin
from millrace.llm.plans import query, table


@query("op10_ngram_join")
def op10_ngram_join(spark, folder):
    found = ngramjoin.jaccard_components(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
