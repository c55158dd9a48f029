r"""Several values packed in one field, one row per value with its position.

The delimiters are inferred per source. Quoted runs are masked first, so a delimiter inside quotes never counts.
Each character that is neither a letter nor a digit is a candidate; for each the fields that hold it are split by
it alone, and two figures are gathered over all fields of the source:

* piece type regularity: the share of pieces that are a chain of values of the source's usual shapes (the digits and
  letters of a value replaced by classes, ``S3-000000007`` being ``A9-9``), joined by other candidates;
* piece-count consistency: the share of fields in which splitting by the candidate alone cuts no value apart, i.e.
  leaves at least as many whole values as pieces that hold a letter, a digit or a quoted run.

A candidate whose product of both reaches ``min_score`` is a delimiter of the source. ``-`` inside an id falls short, as
its pieces have none of the usual shapes. The usual shapes are those of whole fields and of pieces under every candidate, counted
together; a shape counts as usual from ``usual_share`` of the commonest on.

Results: position counts from 1 over items that aren't empty; quotes, one pair of outer brackets and outer blanks are
removed. Null, blank and text that stands for an empty list (EMPTY_TEXTS) give no row. A value without any
delimiter is one piece. Quotes count only where a piece begins. A quote that isn't closed is an ordinary character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for an empty list, after removal of outer blanks, brackets and quotes.
EMPTY_TEXTS = ("", "-", "null", "none", "nil", "nan", "n/a", "na", "<na>", "\\n")

_MASK = "\ue000"
_QUOTED = "\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'"
_BLANK = "(?U)^[\\s\\ufeff\\u200b]+|[\\s\\ufeff\\u200b]+$"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, _BLANK, "")


def _bare(text: Column) -> Column:
    """Outer blanks and one pair of outer brackets removed."""
    t = _strip(text)
    inner = _strip(F.substring(t, F.lit(2), F.length(t) - 2))
    wrapped = (F.length(t) >= 2) & F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1)).isin("[]", "{}", "()")
    return F.when(wrapped, inner).otherwise(t)


def _masked(text: Column) -> Column:
    return F.regexp_replace(text, _QUOTED, _MASK)


def _shape(piece: Column) -> Column:
    letters = F.regexp_replace(piece, "(?U)\\p{L}+", "A")
    return F.regexp_replace(letters, "(?U)\\d+", "9")


def _meant(bare: Column) -> Column:
    unquoted = F.regexp_replace(bare, "^[\"']+|[\"']+$", "")
    return ~F.lower(_strip(unquoted)).isin(*EMPTY_TEXTS)


def infer_delimiters(fields: DataFrame, field: str, source: str | None = None, min_score: float = 0.5, usual_share: float = 0.02) -> DataFrame:
    """(source, delimiter, regularity, consistency, score, chosen) of every candidate; source is '' without a column."""
    key = F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit("")
    rows = fields.select(key.alias("source"), _bare(F.col(field)).alias("bare")).where(F.col("bare").isNotNull() & _meant(F.col("bare")))
    # Fields alike in shape behave alike: the work after this line is over distinct shapes with their counts.
    shapes = rows.groupBy("source", _shape(_masked(F.col("bare"))).alias("shape")).agg(F.count("*").alias("n"))
    candidates = F.array_distinct(F.split(F.regexp_replace("shape", f"[A9{_MASK}]", ""), ""))
    split = (
        shapes.withColumn("delimiter", F.explode(F.filter(candidates, lambda c: c != "")))
        .withColumn("pieces", F.expr("filter(transform(split(shape, concat('\\\\Q', delimiter, '\\\\E')), p -> trim(p)), p -> regexp_like(p, '[A9\ue000]'))"))
        .select("source", "shape", "delimiter", "n", "pieces")
    )
    whole = shapes.select("source", F.trim("shape").alias("piece"), "n")
    parts = split.select("source", F.explode("pieces").alias("piece"), "n")
    counted = whole.unionByName(parts).groupBy("source", "piece").agg(F.sum("n").alias("n"))
    # A usual shape is a whole value: it holds no blank, and it isn't a part of a longer usual shape.
    best = counted.where(F.col("piece").rlike(f"^[^\\s{_MASK},;|]+$")).groupBy("source").agg(F.max_by("piece", F.struct("n", "piece")).alias("top"), F.max("n").alias("most"))
    usual = (
        counted.where(F.col("piece") != _MASK).join(F.broadcast(best), "source")
        .where((F.col("piece") == F.col("top")) | ((F.col("n") >= usual_share * F.col("most")) & F.col("top").contains(F.col("piece")) & (F.length("piece") > F.length("top"))))
        .groupBy("source").agg(F.sort_array(F.collect_set("piece")).alias("usual"))
    )
    whole_value = F.concat(F.lit(f"(?:{_MASK}|"), F.array_join(F.transform("usual", lambda u: F.concat(F.lit("\\Q"), u, F.lit("\\E"))), "|"), F.lit(")"))
    chain = F.concat(F.lit("^"), whole_value, F.lit(f"(?:[^A9{_MASK}]+"), whole_value, F.lit(")*[^A9]*$"))
    scored = (
        split.join(F.broadcast(usual), "source", "left")
        .withColumn("usual", F.coalesce("usual", F.array(F.lit("A"), F.lit("9"))))
        .withColumn("chain", chain)
        .withColumn("regular", F.expr("size(filter(pieces, p -> regexp_like(p, chain)))"))
        .groupBy("source", "delimiter")
        .agg(
            (F.sum(F.col("n") * F.col("regular")) / F.greatest(F.sum(F.col("n") * F.size("pieces")), F.lit(1))).alias("regularity"),
            (F.sum(F.when(F.col("regular") >= F.size("pieces"), F.col("n")).otherwise(0)) / F.sum("n")).alias("consistency"),
        )
    )
    score = F.col("regularity") * F.col("consistency")
    return scored.withColumn("score", score).withColumn("chosen", score >= min_score)


def unpack(fields: DataFrame, field: str, keep: list[str], source: str | None = None, item: str = "item", pos: str = "pos", min_score: float = 0.5) -> DataFrame:
    """``keep``, position and value of each item. Clashing names in ``fields`` don't matter, as only ``keep`` is carried."""
    found = infer_delimiters(fields, field, source, min_score).where("chosen")
    delimiters = found.groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("delimiter")), "").alias("delimiters"))
    inside = F.regexp_replace("delimiters", "([^\\s\\p{L}\\p{N}])", "\\\\$1")
    end = F.concat(F.lit("(?=\\s*(?:["), inside, F.lit("]|\\z))"))
    pattern = F.concat(F.lit('"(?:[^"]|"")*"'), end, F.lit("|'(?:[^']|'')*'"), end, F.lit("|[^"), inside, F.lit("]+"))
    patterns = delimiters.select(F.col("source").alias("__source"), pattern.alias("__pattern"))
    key = F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit("")
    rows = fields.select(*keep, key.alias("__source"), _bare(F.col(field)).alias("__bare")).where(F.col("__bare").isNotNull() & _meant(F.col("__bare")))
    rows = rows.join(F.broadcast(patterns), "__source", "left")
    pieces = F.regexp_extract_all("__bare", F.coalesce("__pattern", F.lit("(?s).+")), F.lit(0))
    kept = F.filter(F.transform(pieces, _item), lambda p: p != "")
    return rows.select(*keep, F.posexplode(kept).alias("__at", item)).select(*keep, (F.col("__at") + 1).cast("int").alias(pos), item)


def _item(piece: Column) -> Column:
    bare = F.regexp_replace(_strip(piece), "(?s)^\"(.*)\"$|^'(.*)'$", "$1$2")
    return _strip(F.replace(bare, F.lit('""'), F.lit('"')))
