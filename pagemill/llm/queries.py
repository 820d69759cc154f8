"""The queries of the ten problems. Each takes (spark, data directory) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import encoding, knn, langid, mixing, neardup, quality, scan_noise, split, subjects, tokenizer
from pagemill.sources.shared import write_through
from pagemill.sources.tables import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.noisy_lines(*(read_table(spark, d, t) for t in ("document_pages", "documents", "gold_pages", "common_words")))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.repair_pages(*(read_table(spark, d, t) for t in ("document_pages", "documents", "gold_pages", "common_words")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = quality.classify_pages(read_table(spark, d, "document_pages"), read_table(spark, d, "common_words"))
    return kinds.where("kind != 'prose'").select("document_id", "page_no", "kind")


def p2_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify_pages(read_table(spark, d, "document_pages"), read_table(spark, d, "common_words"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split.broken_chunks(read_table(spark, d, "chunks"), read_table(spark, d, "document_pages"))


def p3_chunks(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(split.page_texts(read_table(spark, d, "document_pages")), ["document_id", "page_no"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.edited_copies(neardup.records(read_table(spark, d, "document_pages"), read_table(spark, d, "chunks")))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.copy_groups(neardup.records(read_table(spark, d, "document_pages"), read_table(spark, d, "chunks")), 0.4, 3, 30)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = encoding.repair_encoding(read_table(spark, d, "document_pages"))
    return found.select("document_id", "page_no", "field").distinct()


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair_encoding(read_table(spark, d, "document_pages"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return knn.clean_vectors(read_table(spark, d, "vector_rows"), read_table(spark, d, "document_embeddings"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.mutual_neighbours(_vectors(spark, d)).select("chunk_a", "chunk_b")


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return knn.nearest(_vectors(spark, d))


def _languages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages, documents = read_table(spark, d, "document_pages"), read_table(spark, d, "documents")
    profiles, common = langid.fit_profiles(pages, documents, read_table(spark, d, "common_words"))
    return langid.page_languages(pages, profiles, common), documents


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found, documents = _languages(spark, d)
    return langid.wrong_labels(write_through(found, "languages"), documents)


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    return langid.document_languages(*_languages(spark, d))


def p7_pages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d)[0]


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, d, "document_pages")
    profiles, common = langid.fit_profiles(pages, read_table(spark, d, "documents"), read_table(spark, d, "common_words"))
    return langid.page_segments(pages, profiles, common)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(read_table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_found(*(read_table(spark, d, t) for t in ("documents", "subject_areas", "subject_labels")))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(*(read_table(spark, d, t) for t in ("documents", "subject_areas", "subject_labels")))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from pagemill.llm.oracle import ORACLE

    return dict(ORACLE)
