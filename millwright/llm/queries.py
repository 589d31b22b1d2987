"""One query for each operator, over its whole table, with the operator's production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.bpe import bpe_decode, bpe_encode
from millwright.llm.common import table
from millwright.llm.extract import extract_text, fit_extractor
from millwright.llm.fingerprints import edited_fingerprints
from millwright.llm.jaccard import jaccard_components
from millwright.llm.media import read_media, store_media
from millwright.llm.pack import pack_documents
from millwright.llm.periods import periodic_runs
from millwright.llm.recompression import repeated_passages
from millwright.llm.secrets import find_secrets
from millwright.llm.spelling import spelling_variants
from millwright.llm.suffix import repeated_spans
from millwright.llm.token_counts import token_counts
from millwright.llm.toxicity import fit_toxicity, score_toxicity


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents")))
    n_tokens = (F.length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract_text(pages.select("page_id", "url", "html"), fit_extractor(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle_words=4, percent=85)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined(F.filter("secrets", lambda s: s["kind"] != "entropy"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), folds=5, held_out_fold=0)
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")
    score = F.col("toxicity")
    return score_toxicity(docs, model).select("doc_id", held_out, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_toxic_spans"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = read_media(store_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
    feature = F.array_join(F.transform("marks", lambda m: F.concat_ws(":", m["t"], F.lower(F.hex(m["pair"])))), ",").alias("feature")
    last = F.substring("payload", -64, 64)
    return media.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(last).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_removed = (F.col("n_bytes") - F.length("kept")).alias("n_removed")
    # beyond the contract: bytes in repeated strings of 400 bytes or in repeated passages of over fifty words, which may take fewer
    n_repeated = F.aggregate("repeated", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_repeated")
    found = repeated_spans(docs, min_bytes=400, passage_words=51)
    return found.select("doc_id", "n_bytes", n_removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"), n_repeated)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed")
    return found.select("doc_id", "n_words", n_removed, F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), least_letters=6, least_times=5, form_times=5, slip=199)


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the words of one document in ten repeat from some place on.

    With h the crc32 of the id and g = h div 10: where 10 divides h, each word i >= a of n becomes word a + (i - a) % p, for
    a = g % n and p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))), " ")

    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w))), F.lit(0))  # the array binds the words once
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longer = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate(F.slice("runs", 2, F.size("runs") + 1), F.get("runs", F.lit(0)), lambda x, y: F.when(longer(y, x), y).otherwise(x))
    lines = F.concat(F.lit(""), F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), ""))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_html_extraction": op3_html_extraction,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_token_counts": op5_token_counts,
    "op6_secret_scans": op6_secret_scans,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_media_columns": op9_media_columns,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_periodic_runs": op13_periodic_runs,
}
