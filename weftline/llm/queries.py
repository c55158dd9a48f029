"""The queries of the llm problems, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import addresses
from weftline.llm.leakage import passages
from weftline.llm.lookalike import alike_pairs, consistent
from weftline.llm.matching import matches
from weftline.llm.splits import assign, linked
from weftline.llm.subjects import subject_areas
from weftline.llm.tokenizer import decode, encode
from weftline.llm.variants import clusters, same_name_pairs
from weftline.operators.components import pairs_within
from weftline.operators.packed_values import unpack
from weftline.plans.training_data import SQL as TRAINING_SQL
from weftline.session import cut
from weftline.sources.tables import table

TEXTS = ["business_name", "business_address"]


def _records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "source2").select(*columns).unionByName(table(spark, folder, "source3").select(*columns))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_name_pairs(table(spark, folder, "name_entries"), "entry_id", "business_name", "country", "entry_a", "entry_b")


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters(table(spark, folder, "name_entries"), "entry_id", "business_name", "country")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return alike_pairs(_records(spark, folder, "entity_id", *TEXTS), "entity_id", TEXTS, "entity_a", "entity_b")


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    return consistent(_records(spark, folder, "entity_id", *TEXTS), TEXTS).select("entity_id", *[c + "_form" for c in TEXTS])


def _linked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "train_matches").select("source1_entity_id", "matched_entity_ids")
    pairs = unpack(rows, "matched_entity_ids", ["source1_entity_id"], item="entity_id").select("source1_entity_id", "entity_id").distinct()
    return rows, linked(rows, "source1_entity_id", pairs, "source1_entity_id", "entity_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs_within(_linked(spark, folder)[1], "component", "source1_entity_id", "entity_a", "entity_b")


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    rows, groups = _linked(spark, folder)
    return assign(rows, "source1_entity_id", cut(groups), {"train": 0.8, "validation": 0.1, "test": 0.1})


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.same_place_pairs(table(spark, folder, "address_entries"), "entry_id", "business_address", "country", "entry_a", "entry_b")


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.clusters(table(spark, folder, "address_entries"), "entry_id", "business_address", "country")


def p6_matches(spark: SparkSession, folder: str, split: str = "test") -> DataFrame:
    columns = ["entity_id", *TEXTS, "country", "data_split"]
    records = _records(spark, folder, *columns).where(F.col("data_split") == split)
    entities = table(spark, folder, "source1").select(*columns).where(F.col("data_split") == split)
    return matches(records, entities).select(F.col("sid").alias("source1_entity_id"), F.col("rid").alias("entity_id"), F.col("many").alias("n_alike"), "confidence")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    # Of entities a record can't tell apart none gets more than its share, which is a half at most.
    return p6_matches(spark, folder).where("confidence > 0.5 and n_alike = 1").select("source1_entity_id", "entity_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"), "doc_id", "text")


def p8_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Encoded and decoded again: the text, '' where it is null."""
    return decode(p8_ids(spark, folder), "doc_id")


def p9_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_passages(spark, folder).select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return subject_areas(*(table(spark, folder, t) for t in ("documents", "subject_labels", "subject_areas")))


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per source and subject."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return p10_found(spark, folder).join(docs, "doc_id").groupBy("source", "subject").agg(F.count("*").alias("n_docs"))


QUERIES = {
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p3_found": p3_found,
    "p3_splits": p3_splits,
    "p4_found": p4_found,
    "p4_clusters": p4_clusters,
    "p6_found": p6_found,
    "p6_matches": p6_matches,
    "p8_ids": p8_ids,
    "p8_texts": p8_texts,
    "p9_found": p9_found,
    "p9_passages": p9_passages,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}

SQL = {
    "p3_found": f"""WITH RECURSIVE listed AS ({TRAINING_SQL['p5_found']}),
e AS (SELECT DISTINCT a.source1_entity_id AS x, b.source1_entity_id AS y FROM listed a JOIN listed b ON a.entity_id = b.entity_id WHERE a.source1_entity_id <> b.source1_entity_id),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT DISTINCT x AS entity_a, y AS entity_b FROM r WHERE x < y""",
    "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
