"""Registered queries of the operators here; each takes (spark, folder of tables) and reads whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from claimloom.llm import boilerplate, dedup, leakage, lookalike, packing, residue, split
from claimloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.copies(table(spark, d, "claims").select("id", "claim_text"))


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return dedup.collapse(table(spark, d, "claims").select("id", "claim_text")).select("kept_id", "copies", "variants")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_paragraphs(spark, d).select("kind", "page_key", F.sha2("paragraph", 256).alias("para_hash"))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.paragraphs(table(spark, d, "resources"), table(spark, d, "source_documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return split.pieces(table(spark, d, "chunks")).where("piece = 0 and pieces > 1").select("id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.pieces(table(spark, d, "chunks"))


def p4_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for the pieces of each oversized chunk, counted over all of them."""
    chunks = table(spark, d, "chunks")
    whole = chunks.where(F.length("text") > split.LIMIT).select("id", F.col("text").alias("whole"), F.col("start_char").alias("base"), F.col("section").alias("its_section"))
    p = split.pieces(chunks).where("pieces > 1").join(whole, "id").withColumn("before", F.lag("rel_end").over(Window.partitionBy("id").orderBy("piece")))
    lo, hi, back = F.col("rel_start"), F.col("rel_end"), F.col("before") - F.col("rel_start")
    wrong_place = ~(F.col("start_char").eqNullSafe(F.col("base") + lo) & F.col("end_char").eqNullSafe(F.col("base") + hi) & F.col("section").eqNullSafe(F.col("its_section")))
    return p.agg(
        F.count_distinct("id").alias("chunks"), F.count_if(F.length("text") > split.LIMIT).alias("over_limit"), F.count_if(F.col("text") != F.substring("whole", lo + 1, hi - lo)).alias("not_a_slice"),
        F.count_if(F.coalesce("before", F.lit(0)) < lo).alias("gaps"), F.count_if((back > split.OVERLAP) | (back < 1)).alias("wrong_overlap"), F.count_if(wrong_place).alias("wrong_place"),
        F.sum(F.when(F.col("piece") == F.col("pieces") - 1, hi)).alias("chars"))


def p1_check(spark: SparkSession, d: str) -> DataFrame:
    """Groups and copies of the two forms of the result agree, and every record is in a group."""
    groups = dedup.collapse(table(spark, d, "claims").select("id", "claim_text")).agg(F.sum("copies").alias("records"), F.sum(F.col("copies") - 1).alias("further"))
    pairs = p1_found(spark, d).agg(F.count("*").alias("pairs"), F.count_distinct("copy_id").alias("different"), F.count_if(F.col("copy_id") <= F.col("kept_id")).alias("not_smallest"))
    return groups.withColumn("one", F.lit(1)).join(pairs.withColumn("one", F.lit(1)), "one").select("records", (F.col("further") - F.col("pairs")).alias("missing"), (F.col("pairs") - F.col("different")).alias("twice"), "not_smallest")


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Every document is marked, with units if and only if it is residue."""
    m = p8_marked(spark, d)
    return m.agg(F.count("*").alias("docs"), F.count_distinct("doc_id").alias("different"), F.count_if(F.col("is_residue").isNull() | (F.col("is_residue") != (F.col("n_units") > 0)) | (F.col("is_residue") != (F.col("units") != ""))).alias("inconsistent"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    parts = [("claims", "id", "claim_text"), ("extracted_pages", "page_id", "text"), ("evidence_candidates", "candidate_id", "quote")]
    one = [table(spark, d, t).select(F.lit(t).alias("tab"), F.col(k).cast("long").alias("key"), F.col(x).alias("text")) for t, k, x in parts]
    return one[0].unionByName(one[1]).unionByName(one[2])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking_pairs(lookalike.repaired(_texts(spark, d)))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking_classes(lookalike.repaired(_texts(spark, d)))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    f = lookalike.repaired(_texts(spark, d))
    return f.select("tab", "key", "form", F.lower(F.hex("form_hash")).alias("form_hash"), "n_repaired", "n_unknown")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A public vocabulary file: in the folder CLAIMLOOM_TOKENIZERS names, else where the box has it."""
    return os.path.join(os.environ.get("CLAIMLOOM_TOKENIZERS", "/opt/tokenizers"), name)


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), vocabulary_path())


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    c = packing.checked(p6_packed(spark, d))
    return c.select("docs", "chars", "over_capacity", "misplaced", "split_needlessly", (F.col("fill") >= 0.95).alias("well_filled"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.checked(p6_packed(spark, d)).select("containers", "fill")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_matches(spark, d).where("kind = 'phrase'").select("doc_id", "item_id")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_marked(spark, d).where("is_residue").select("doc_id")


def p8_marked(spark: SparkSession, d: str) -> DataFrame:
    return residue.marked(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_collapsed": p1_collapsed,
    "p1_check": p1_check,
    "p3_found": p3_found,
    "p3_paragraphs": p3_paragraphs,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_check": p4_check,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p5_forms": p5_forms,
    "p6_packed": p6_packed,
    "p6_check": p6_check,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_matches": p7_matches,
    "p8_found": p8_found,
    "p8_marked": p8_marked,
    "p8_check": p8_check,
}
