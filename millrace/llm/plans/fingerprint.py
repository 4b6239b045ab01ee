"""Order MinHash fingerprints of all documents and of their edited texts."""

from millrace.llm import fingerprint
from millrace.llm.plans import query, table


@query("op1_order_minhash")
def op1_order_minhash(spark, folder):
    return fingerprint.fingerprint_edits(table(spark, folder, "documents"))
