"""Queries of the two general training-data problems, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.hot_keys import eager_join_aggregate, hot_keys, per_key
from weftline.operators.packed_values import infer_delimiters, unpack
from weftline.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "train_matches")
    return unpack(rows, "matched_entity_ids", ["source1_entity_id"], item="entity_id").distinct()


def p5_delimiters(spark: SparkSession, folder: str) -> DataFrame:
    d = infer_delimiters(table(spark, folder, "train_matches"), "matched_entity_ids")
    return d.select("delimiter", F.round("regularity", 6).alias("regularity"), F.round("consistency", 6).alias("consistency"), "chosen")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidate_pairs").select("c0", "country", "comb")
    return hot_keys(rows, ["c0", "country"], "comb", 0.03).select("key_column", "key_value")


def p7_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidate_pairs").select("c0", "c1", "country", "comb")
    out = per_key(rows, ["c0", "country"], "c1", "comb")
    return out.select("key_column", "key_value", "n_rows", F.col("n_values").alias("n_c1"), F.round(F.col("best").cast("double"), 6).alias("best_comb"))


def p7_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate pairs met with the records they name: rows and best score per country of the pair, deliveries repeated."""
    pairs = table(spark, folder, "candidate_pairs").select("c1", "country", "rk", "comb")
    records = table(spark, folder, "source2").select("entity_id").unionByName(table(spark, folder, "source3").select("entity_id"))
    out = eager_join_aggregate(pairs, records.withColumnRenamed("entity_id", "c1"), "c1", ["country"], left_sums=["rk"], left_maxima=["comb"])
    return out.select("country", "n_joined", F.col("sum_rk").cast("long").alias("sum_rk"), F.round(F.col("max_comb").cast("double"), 6).alias("max_comb"))


QUERIES = {"p5_found": p5_found, "p5_delimiters": p5_delimiters, "p7_found": p7_found, "p7_totals": p7_totals, "p7_joined": p7_joined}

_P7_KEYS = """SELECT 'c0' AS key_column, c0 AS key_value, c1, comb FROM candidate_pairs
UNION ALL SELECT 'country', country, c1, comb FROM candidate_pairs"""

SQL = {
    "p7_found": f"""WITH k AS ({_P7_KEYS})
SELECT key_column, key_value FROM k WHERE key_value IS NOT NULL GROUP BY ALL
HAVING count(*) > 0.03 * (SELECT count(*) FROM candidate_pairs)""",
    "p7_totals": f"""WITH k AS ({_P7_KEYS})
SELECT key_column, key_value, count(*) AS n_rows, count(DISTINCT c1) AS n_c1, round(CAST(max(comb) AS DOUBLE), 6) AS best_comb
FROM k WHERE key_value IS NOT NULL GROUP BY ALL""",
    "p7_joined": """WITH r AS (SELECT entity_id FROM source2 UNION ALL SELECT entity_id FROM source3)
SELECT p.country, count(*) AS n_joined, CAST(sum(p.rk) AS BIGINT) AS sum_rk, round(CAST(max(p.comb) AS DOUBLE), 6) AS max_comb
FROM candidate_pairs p JOIN r ON r.entity_id = p.c1 GROUP BY p.country""",
    "p5_found": r"""WITH f AS (
  SELECT source1_entity_id, list_transform(regexp_extract_all(matched_entity_ids, '"[^"]*"|''[^'']*''|[^\s,;|/+&、，；"''\[\](){}]+'), lambda x: trim(x, '"'' ')) AS ids
  FROM train_matches WHERE matched_entity_ids IS NOT NULL AND lower(trim(matched_entity_ids)) NOT IN ('', '-', 'null', 'none')
), g AS (SELECT source1_entity_id, list_filter(ids, lambda x: x <> '') AS ids FROM f)
SELECT DISTINCT source1_entity_id, CAST(pos AS INTEGER) AS pos, ids[pos] AS entity_id
FROM (SELECT source1_entity_id, ids, unnest(range(1, len(ids) + 1)) AS pos FROM g)""",
}
