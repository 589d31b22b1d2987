"""A corpus from raw documents: screened, deduplicated, cleaned of secrets, packed into sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again for the next.  All but
the last return the columns of documents.  Rows with null or empty texts pass through every stage; packing gives them a piece
that holds only the end of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.common import MARKS, table, written
from millwright.llm.jaccard import jaccard_components
from millwright.llm.pack import pack_documents
from millwright.llm.secrets import redact_secrets
from millwright.llm.suffix import repeated_spans
from millwright.llm.toxicity import fit_toxicity, score_toxicity

#: Documents at or above this score go.
TOXIC_SCORE = 0.5
#: Repeated byte strings of this length or more are cut out, and repeated passages of so many words, which may be shorter.
REPEATED_BYTES, REPEATED_WORDS = 224, 51


def _same_columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from a stage's result, with n_chars counted anew where there is one."""
    kept = {c.lower() for c in docs.columns}
    out = found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in kept else found
    return out.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects; it learns from all labels but reads only texts."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), held_out_fold=None)
    return score_toxicity(docs, model).filter(F.col("toxicity") < TOXIC_SCORE).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8) the document with the smallest id; of rows that repeat id and text one."""
    groups = jaccard_components(docs, shingle_words=5, percent=80).filter("doc_id is not null")
    named = groups.groupBy("doc_id").agg(F.count("*").alias("__rows"), F.max(F.col("doc_id") != F.col("component_id")).alias("__goes"))
    concerned = written(named.filter("__goes or __rows > 1"))
    # most documents have a mark that no concerned one has, and are kept where they lie; there are at most MARKS marks
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)).alias("__mark")
    marks = F.broadcast(concerned.select(mark).distinct())
    marked = docs.select("*", mark)
    clear = marked.join(marks, "__mark", "left_anti").select(*docs.columns)
    found = marked.join(marks, "__mark", "left_semi").join(concerned, "doc_id", "left").filter("not coalesce(__goes, false)")
    single = found.filter("coalesce(__rows, 1) = 1").select(*docs.columns)
    repeated = found.filter("__rows > 1").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return clear.unionByName(single).unionByName(repeated)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the text that stands in two places or more, whole characters at a time.  Every document stays."""
    found = repeated_spans(docs, min_bytes=REPEATED_BYTES, gram=32, whole_characters=True, min_words=REPEATED_WORDS)
    text = F.when(F.col("text").isNull(), None).otherwise(F.decode("kept", "UTF-8"))
    return _same_columns(found.withColumn("text", text), docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With a mark in the place of every secret.  Every document stays."""
    return _same_columns(redact_secrets(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, piece, start, length, ids, sequence_id, offset."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("secret scans", redact),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; what each returns is written to the shared folder first."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


#: No SQL: the stages fit a model and cut at byte positions; tests compare them with brute-force versions.
ORACLE_SQL = None
