"""The language of all documents, learned from three quarters of them."""

from pyspark.sql import functions as F

from millrace.llm import langid
from millrace.llm.plans import query, table


@query("op5_byte_cnn")
def op5_byte_cnn(spark, folder):
    documents = table(spark, folder, "documents")
    marked = documents.withColumn("held_out", langid.is_held_out(F.col("doc_id")))
    net = langid.fit(marked.where(~F.col("held_out")))
    return langid.predict(marked, net, into=("doc_id", "held_out"))
