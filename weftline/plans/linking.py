"""The linking operators as queries over the project's tables, with the SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import normalise as N
from weftline.operators import blocking as B
from weftline.operators import context as C
from weftline.operators import metrics as M
from weftline.operators import retrieval as S
from weftline.operators.packed_values import unpack
from weftline.operators.word_sets import word_codes
from weftline.plans.training_data import SQL as TRAINING_SQL
from weftline.session import cut
from weftline.sources.tables import table

COLUMNS = ["entity_id", "business_name", "business_address", "country"]
CAPS = {"nw": 5000, "nc": 2000, "ad": 2000}


# ------------------------------------------------------------------ inputs


def heads(spark: SparkSession, folder: str) -> DataFrame:
    """Head offices of chains in the form of source1, without a split and so without a label."""
    return table(spark, folder, "chain_heads").select(*COLUMNS, F.lit(None).cast("string").alias("data_split"))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """What c0 of a candidate pair may name: the rows of source1 and the chain heads."""
    return table(spark, folder, "source1").select(*COLUMNS, "data_split").unionByName(heads(spark, folder)).distinct()


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(src, columns) of all sources; deliveries once."""
    parts = [table(spark, folder, f"source{i}").select(F.lit(i).cast("byte").alias("src"), *COLUMNS, "data_split") for i in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(q, s, scores) of the candidate pairs, repeated rows once; p in 0..1 from the combined score."""
    raw = table(spark, folder, "candidate_pairs").where("c0 is not null and c1 is not null")
    best = raw.groupBy(F.col("c1").alias("q"), F.col("c0").alias("s")).agg(*[F.max(c).cast("double").alias(c) for c in ("sc_nw", "sc_nc", "sc_ad", "comb")], F.min("rk").cast("int").alias("rk"))
    return best.withColumn("p", F.least(F.greatest(F.col("comb") / 3.0, F.lit(0.0)), F.lit(1.0)))


def truth(spark: SparkSession, folder: str) -> DataFrame:
    listed = unpack(table(spark, folder, "train_matches"), "matched_entity_ids", ["source1_entity_id"], item="entity_id")
    return listed.select(F.col("entity_id").alias("q"), F.col("source1_entity_id").alias("s")).distinct()


def words(text: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(N.fold_latin(F.col(text) if isinstance(text, str) else text), F.lit("[a-z0-9]+"), F.lit(0)))


def with_heads(spark: SparkSession, folder: str) -> DataFrame:
    """records and, as src 0, the chain heads: all that a candidate pair joins."""
    return records(spark, folder).unionByName(heads(spark, folder).select(F.lit(0).cast("byte").alias("src"), "*").distinct())


def simple(spark: SparkSession, folder: str) -> DataFrame:
    """(id, src, country, data_split, nw, ad, nums): words and numbers by one plain pattern."""
    return simple_form(records(spark, folder))


def simple_form(r: DataFrame) -> DataFrame:
    numbers = F.transform(F.regexp_extract_all(N.fold_latin(F.col("business_address")), F.lit("[0-9]+"), F.lit(0)), lambda n: F.regexp_replace(n, "^0+(?=[0-9])", ""))
    return r.select(F.col("entity_id").alias("id"), "src", F.coalesce("country", F.lit("")).alias("country"), "data_split", words("business_name").alias("nw"), words("business_address").alias("ad"), numbers.alias("nums"))


def simple_features(rows: DataFrame) -> DataFrame:
    """(id, src, country, ch, feat)."""
    each = F.array(F.struct(F.lit("nw").alias("ch"), F.col("nw").alias("fs")), F.struct(F.lit("nc").alias("ch"), F.array_distinct(N.grams(F.array_join("nw", ""))).alias("fs")), F.struct(F.lit("ad").alias("ch"), F.col("ad").alias("fs")))
    out = rows.select("id", "src", "country", F.explode(each).alias("c")).select("id", "src", "country", "c.ch", F.explode("c.fs").alias("feat"))
    return out.where("feat <> '##'")


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source1").groupBy(F.coalesce("country", F.lit("")).alias("country")).agg(F.countDistinct("entity_id").alias("n_index"))


def _texts(spark: SparkSession, folder: str, sources: list[int]) -> DataFrame:
    """(id, country, names, addresses) of the records of these sources: the folded texts of all rows of an id and country. What is exchanged are these rows."""
    folded = [N.fold_latin(F.col(c)).alias(c) for c in ("business_name", "business_address")]
    parts = [table(spark, folder, f"source{i}").select(F.col("entity_id").alias("id"), F.coalesce("country", F.lit("")).alias("country"), *folded) for i in sources]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    # Searching costs far more than its bytes tell, so the number of partitions is not left to their size.
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").groupBy("id", "country")
    return dealt.agg(F.collect_set("business_name").alias("names"), F.collect_set("business_address").alias("addresses"))


def _search(spark: SparkSession, folder: str, caps: dict[str, int], k: int, kc: int, wide_caps: dict[str, int] | None = None) -> DataFrame:
    asked, index = (_texts(spark, folder, sources) for sources in ([2, 3], [1]))
    return S.search_sets(asked, index, _sizes(spark, folder), caps, k, kc, wide_caps, coded=word_codes(list(caps)))


def sides(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate pairs with both records' arrays and the label (1 listed, 0 not; only entities of the train split)."""
    r = simple_form(with_heads(spark, folder))
    q = r.where("src > 1").select(F.col("id").alias("q"), F.col("nw").alias("q_nw"), F.col("nums").alias("q_nums"), F.col("ad").alias("q_ad"))
    s = r.where("src <= 1").select(F.col("id").alias("s"), "country", "data_split", F.col("nw").alias("s_nw"), F.col("nums").alias("s_nums"), F.col("ad").alias("s_ad"))
    t = truth(spark, folder).withColumn("hit", F.lit(1))
    met = pairs(spark, folder).join(q, "q").join(s, "s").join(t, ["q", "s"], "left")
    return met.withColumn("y", F.when(F.col("data_split") == "train", F.coalesce("hit", F.lit(0)))).drop("hit")


# ------------------------------------------------------------------ SQL pieces


def _case(word: str, forms: list[str]) -> str:
    whens = " ".join(f"WHEN '{w}' THEN '{g.split()[0]}'" for g in forms for w in g.split())
    return f"CASE {word} {whens} ELSE {word} END"


def _quoted(ws: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in ws)


def _fold(c: str) -> str:
    return rf"regexp_replace(translate(lower(coalesce({c}, '')), '{N.ACCENTED}', '{N.PLAIN}'), '[^\x00-\x7f]', ' ', 'g')"


_RECORDS = """records AS (SELECT DISTINCT CAST(1 AS TINYINT) AS src, entity_id, business_name, business_address, country, data_split FROM source1
UNION ALL SELECT DISTINCT CAST(2 AS TINYINT), entity_id, business_name, business_address, country, data_split FROM source2
UNION ALL SELECT DISTINCT CAST(3 AS TINYINT), entity_id, business_name, business_address, country, data_split FROM source3)"""
_SIMPLE = f"""simple AS (SELECT entity_id AS id, src, coalesce(country, '') AS country, data_split, ordered_distinct(regexp_extract_all({_fold('business_name')}, '[a-z0-9]+')) AS nw,
 ordered_distinct(regexp_extract_all({_fold('business_address')}, '[a-z0-9]+')) AS ad,
 list_transform(regexp_extract_all({_fold('business_address')}, '[0-9]+'), lambda n: regexp_replace(n, '^0+([0-9])', '\\1')) AS nums FROM records)"""
# Distinct words in order of first occurrence.


def _ordered(sql: str) -> str:
    """DuckDB's list_distinct has no order; keep words whose first place is their own."""
    out, mark = "", "ordered_distinct("
    while mark in sql:
        head, rest = sql.split(mark, 1)
        depth, i = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[i], 0) if not _in_quotes(rest, i) else 0
            i += 1
        inner = rest[: i - 1]
        sql = head + f"list_filter({inner}, lambda x, i: list_position({inner}, x) = i)" + rest[i:]
    return out + sql


def _in_quotes(text: str, at: int) -> bool:
    return text[:at].count("'") % 2 == 1


_SIMPLE = _ordered(_SIMPLE)
_PAIRS = """pairs AS (SELECT c1 AS q, c0 AS s, max(sc_nw)::DOUBLE AS sc_nw, max(sc_nc)::DOUBLE AS sc_nc, max(sc_ad)::DOUBLE AS sc_ad, max(comb)::DOUBLE AS comb, min(rk)::INT AS rk,
 least(greatest(max(comb)::DOUBLE / 3.0, 0.0), 1.0) AS p FROM candidate_pairs WHERE c0 IS NOT NULL AND c1 IS NOT NULL GROUP BY c1, c0)"""
_TRUTH = f"listed AS ({TRAINING_SQL['p5_found']}), truth AS (SELECT DISTINCT entity_id AS q, source1_entity_id AS s FROM listed)"
_SIDES = """sides AS (SELECT p.*, a.nw AS q_nw, a.nums AS q_nums, a.ad AS q_ad, b.country, b.data_split, b.nw AS s_nw, b.nums AS s_nums, b.ad AS s_ad,
 CASE WHEN b.data_split = 'train' THEN CASE WHEN t.q IS NULL THEN 0 ELSE 1 END END AS y
 FROM pairs p JOIN simple a ON a.id = p.q AND a.src > 1 JOIN simple b ON b.id = p.s AND b.src <= 1 LEFT JOIN truth t ON t.q = p.q AND t.s = p.s)"""
_WITH_HEADS = _RECORDS[:-1] + """
UNION ALL SELECT DISTINCT CAST(0 AS TINYINT), entity_id, business_name, business_address, country, CAST(NULL AS VARCHAR) FROM chain_heads)"""
_ENTITIES = "(SELECT DISTINCT entity_id, country FROM source1 UNION SELECT DISTINCT entity_id, country FROM chain_heads)"
_ALL = f"WITH {_WITH_HEADS}, {_SIMPLE}, {_PAIRS}, {_TRUTH}, {_SIDES}"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# ------------------------------------------------------------------ scans, joins, normalisation


@query(f"WITH {_RECORDS} SELECT src, country, count(*) AS n, count(business_name) AS n_named FROM records GROUP BY src, country")
def source_union(spark, folder):
    return records(spark, folder).groupBy("src", "country").agg(F.count("*").alias("n"), F.count("business_name").alias("n_named"))


@query(f"WITH {_RECORDS}, {_TRUTH} SELECT t.s, t.q, a.business_name AS s_name, b.business_name AS q_name FROM truth t JOIN records a ON a.entity_id = t.s AND a.src = 1 JOIN records b ON b.entity_id = t.q AND b.src > 1")
def truth_links(spark, folder):
    r = records(spark, folder)
    s, q = r.where("src = 1").select(F.col("entity_id").alias("s"), F.col("business_name").alias("s_name")), r.where("src > 1").select(F.col("entity_id").alias("q"), F.col("business_name").alias("q_name"))
    return truth(spark, folder).join(s, "s").join(q, "q").select("s", "q", "s_name", "q_name")


_MIXED = "regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '^[0-9]+(?:st|nd|rd|th)$')"


def _tokens_sql(column: str) -> str:
    runs = rf"regexp_extract_all({column}, '\b[a-z](?:\.[a-z]\b)+')"
    dotless = f"list_reduce(list_prepend({column}, {runs}), lambda acc, r: replace(acc, r, replace(r, '.', '')))"
    spaced = f"regexp_replace(replace({dotless}, '.', ' '), '[&+]', ' & ', 'g')"
    mended = f"list_transform(regexp_extract_all({spaced}, '[a-z0-9]+|&'), lambda t: CASE WHEN {_MIXED} THEN translate(t, '{N.DIGITS}', '{N.LETTERS}') ELSE t END)"
    return f"list_transform({mended}, lambda t: {_case('t', N.LEGAL_FORMS)})"


_LEFT_OUT = _quoted([*N.LEGAL_TOKENS, *N.HONORIFICS, *N.STOP_WORDS, "&"])


@query(f"""WITH {_RECORDS}, f AS (SELECT entity_id, {_fold('business_name')} AS s FROM records), t AS (SELECT entity_id, {_tokens_sql('s')} AS toks FROM f)
SELECT entity_id, array_to_string(toks, ' ') AS n_toks, array_to_string(list_filter(toks, lambda t: t NOT IN ({_LEFT_OUT})), ' ') AS n_core FROM t""")
def name_tokens(spark, folder):
    toks = N.name_tokens(N.fold_latin(F.col("business_name")))
    return records(spark, folder).select("entity_id", toks.alias("t")).select("entity_id", F.array_join("t", " ").alias("n_toks"), F.array_join(N.core_tokens(F.col("t")), " ").alias("n_core"))


_WEB_SQL = N.WEB.replace("'", "''")
_ALIAS_SQL = N.ALIAS.replace("'", "''")
SQL["name_parts"] = f"""WITH {_RECORDS}, a AS (SELECT entity_id, business_name AS raw, list_filter(list_transform(string_split({_fold('business_name')}, '|'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM records),
b AS (SELECT *, ' ' || coalesce(parts[1], '') || ' ' AS padded, length(regexp_extract(' ' || coalesce(parts[1], '') || ' ', '(?is)^(.*?){_ALIAS_SQL}', 1)) > 0 AS is_alias FROM a),
c AS (SELECT *, CASE WHEN is_alias THEN trim(regexp_replace(padded, '(?is)^.*?{_ALIAS_SQL}', '')) ELSE coalesce(parts[1], '') END AS main FROM b),
d AS (SELECT *, regexp_extract(main, '{_WEB_SQL}', 1) AS main_web, coalesce(list_filter(list_transform(parts[2:], lambda p: regexp_extract(p, '{_WEB_SQL}', 1)), lambda w: w <> '')[1], '') AS other_web FROM c),
e AS (SELECT *, replace(CASE WHEN main_web <> '' THEN main_web ELSE other_web END, '-', '') AS web, CASE WHEN main_web <> '' THEN trim(regexp_replace(main, '{_WEB_SQL}', ' ')) ELSE main END AS bare FROM d),
g AS (SELECT *, regexp_replace(regexp_replace(bare, '{N.PHONE}', ' ', 'g'), '\\bm/s\\b', ' ', 'g') AS clean FROM e),
h AS (SELECT *, {_tokens_sql('clean')} AS toks0 FROM g), k AS (SELECT *, CASE WHEN len(toks0) = 0 AND web <> '' THEN [web] ELSE toks0 END AS toks FROM h)
SELECT entity_id, array_to_string(toks, ' ') AS n_toks, array_to_string(list_filter(toks, lambda t: t NOT IN ({_LEFT_OUT})), ' ') AS n_core, web AS n_web,
CAST(CASE WHEN regexp_matches(coalesce(raw, ''), '[ऀ-෿]') THEN 1 ELSE 0 END + CASE WHEN is_alias THEN 2 ELSE 0 END + CASE WHEN main_web <> '' THEN 4 ELSE 0 END + CASE WHEN len(parts) > 1 THEN 8 ELSE 0 END AS SMALLINT) AS n_flags FROM k"""


@query()
def name_parts(spark, folder):
    r = records(spark, folder).select("entity_id", "business_name")
    return N.with_name_parts(r, N.fold_latin(F.col("business_name")), F.col("business_name")).drop("business_name").withColumns({c: F.array_join(c, " ") for c in ("n_toks", "n_core")})


def _phrases_sql(s: str, table_: list[tuple[str, str]]) -> str:
    for k, v in table_:
        s = rf"regexp_replace({s}, '\b{k}\b', ' {v} ', 'g')"
    return s


def _last(codes: list[str]) -> str:
    return f"coalesce(list_filter(toks, lambda t: t IN ({_quoted(codes)}))[-1], '')"


_IN_CODES = sorted({c for _, c in N.IN_STATES} | set(N.IN_ALIASES))
SQL["address_parts"] = rf"""WITH {_RECORDS}, a AS (SELECT entity_id, country, regexp_replace(regexp_replace(translate(lower(translate(regexp_replace(coalesce(business_address, ''), '[nN]\s*[°º]', ' no ', 'g'), '°º', '  ')), '{N.ACCENTED}', '{N.PLAIN}'), '[^\x00-\x7f]', ' ', 'g'), '\b(?:null|n/a|none)\b', ' ', 'g') AS s FROM records),
b AS (SELECT entity_id, country, regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(s, '\b(\d+)\s*(?:st|nd|rd|th)\b', '\1', 'g'), ','), lambda p: trim(p)), lambda p: p NOT IN ('', 'null', 'na', 'n/a')), ' , '), '[\-''/.]', ' ', 'g') AS s FROM a),
c AS (SELECT entity_id, country, regexp_extract_all(CASE country WHEN 'US' THEN {_phrases_sql('s', N.US_STATES)} WHEN 'India' THEN {_phrases_sql('s', N.IN_STATES)} WHEN 'France' THEN {_phrases_sql('s', N.FR_REGIONS)} ELSE s END, '[a-z]+|\d+') AS raw FROM b),
d AS (SELECT entity_id, country, list_filter(list_transform(list_filter(raw, lambda t: NOT regexp_matches(t, '^\d')), lambda t: {_case('t', N.STREET_FORMS)}), lambda t: t NOT IN ({_quoted(N.ADDRESS_NOISE)}) AND NOT (coalesce(country, '') = 'France' AND t IN ({_quoted(N.ADDRESS_NOISE_FR)}))) AS toks,
list_transform(list_filter(raw, lambda t: regexp_matches(t, '^\d')), lambda t: regexp_replace(t, '^0+(\d)', '\1')) AS nums FROM c)
SELECT entity_id, array_to_string(toks, ' ') AS a_toks, array_to_string(nums, ' ') AS a_nums, CASE country WHEN 'US' THEN {_last(sorted({c for _, c in N.US_STATES}))} WHEN 'India' THEN CASE {_last(_IN_CODES)} WHEN 'ts' THEN 'tg' WHEN 'or' THEN 'od' WHEN 'ct' THEN 'cg' ELSE {_last(_IN_CODES)} END WHEN 'France' THEN {_last(['hdf', 'naq', 'pdl'])} ELSE '' END AS a_state FROM d"""


@query()
def address_parts(spark, folder):
    folded = N.fold_latin(N.number_marks(F.coalesce("business_address", F.lit(""))))
    r = records(spark, folder).select("entity_id", "business_address", "country")
    return N.with_address_parts(r, folded, F.col("country")).drop("business_address", "country").withColumns({c: F.array_join(c, " ") for c in ("a_toks", "a_nums")})


# ------------------------------------------------------------------ retrieval

_FEATS = """feats AS (SELECT DISTINCT id, src, country, ch, feat FROM (
 SELECT id, src, country, 'nw' AS ch, unnest(nw) AS feat FROM simple
 UNION ALL SELECT id, src, country, 'nc', unnest(list_transform(range(1, greatest(length('#' || array_to_string(nw, '') || '#') - 3, 1) + 1), lambda i: substring('#' || array_to_string(nw, '') || '#', i, 4))) FROM simple
 UNION ALL SELECT id, src, country, 'ad', unnest(ad) FROM simple) WHERE feat <> '##')"""
_VOCAB = """sizes AS (SELECT coalesce(country, '') AS country, count(DISTINCT entity_id) AS n_index FROM source1 GROUP BY 1),
vocab AS (SELECT f.country, ch, feat, count(*) AS df, any_value(n_index) AS n_index, ln((any_value(n_index) + 1) / (count(*) + 0.5)) AS idf FROM feats f JOIN sizes z ON z.country = f.country WHERE src = 1 GROUP BY f.country, ch, feat)"""


def _search_sql(channels: list[str], caps: dict[str, int], name: str, only: str = "") -> str:
    cap = " OR ".join(f"(ch = '{c}' AND df <= {caps[c]})" for c in channels)
    cols = ", ".join(f"max(CASE WHEN ch = '{c}' THEN sc ELSE 0.0 END) AS sc_{c}" for c in channels)
    comb = " + ".join(f"sc_{c} * 1.0" for c in channels)
    return f"""k_{name} AS (SELECT f.id, f.country, f.ch, f.feat, df, coalesce(idf, ln((z.n_index + 1) / 0.5)) AS idf FROM feats f JOIN sizes z ON z.country = f.country LEFT JOIN vocab v ON v.country = f.country AND v.ch = f.ch AND v.feat = f.feat WHERE src > 1 AND f.ch IN ({_quoted(channels)}) {only}),
qn_{name} AS (SELECT id, ch, sqrt(sum(idf * idf)) AS qn FROM k_{name} GROUP BY id, ch),
w_{name} AS (SELECT f.id, f.country, f.ch, f.feat, df, idf FROM feats f JOIN vocab v ON v.country = f.country AND v.ch = f.ch AND v.feat = f.feat WHERE src = 1 AND f.ch IN ({_quoted(channels)})),
sn_{name} AS (SELECT id, ch, sqrt(sum(idf * idf)) AS sn FROM w_{name} GROUP BY id, ch),
dot_{name} AS (SELECT k.id AS q, w.id AS s, k.country, k.ch, sum(k.idf * k.idf) AS dot FROM (SELECT * FROM k_{name} WHERE {cap}) k JOIN (SELECT * FROM w_{name} WHERE {cap}) w ON w.country = k.country AND w.ch = k.ch AND w.feat = k.feat GROUP BY 1, 2, 3, 4),
cos_{name} AS (SELECT d.q, d.s, d.country, d.ch, round(dot / (qn * sn), 6) AS sc FROM dot_{name} d JOIN qn_{name} a ON a.id = d.q AND a.ch = d.ch JOIN sn_{name} b ON b.id = d.s AND b.ch = d.ch),
sc_{name} AS (SELECT *, round({comb}, 6) AS comb FROM (SELECT q, s, country, {cols} FROM cos_{name} GROUP BY q, s, country))"""


def _best_sql(channels: list[str], name: str, k: int, kc: int) -> str:
    cols = ", ".join(["q", "s", "country", *[f"sc_{c}" for c in channels], "comb"])
    top = f"SELECT {cols}, CAST(row_number() OVER (PARTITION BY q ORDER BY comb DESC, s) - 1 AS INT) AS rk FROM sc_{name} QUALIFY rk < {k}"
    extra = [f"SELECT {cols}, 99 AS rk FROM sc_{name} WHERE sc_{c} > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY sc_{c} DESC, s) <= {kc}" for c in channels]
    union = " UNION ALL ".join(f"({x})" for x in [top, *extra])
    return f"best_{name} AS (SELECT {cols}, min(rk) AS rk FROM ({union}) GROUP BY {cols})"


_BASE = f"WITH {_RECORDS}, {_SIMPLE}, {_FEATS}, {_VOCAB}"
_CH = list(CAPS)
_LOW, _WIDE = {"nw": 20, "nc": 10, "ad": 10}, {"nw": 200, "nc": 100, "ad": 100}


@query(f"{_BASE} SELECT country, ch, feat, df, round(idf, 6) AS idf FROM vocab")
def idf_vocab(spark, folder):
    index = cut(simple_features(simple(spark, folder).where("src = 1")).drop("src"))
    v = B.vocabulary(index, _sizes(spark, folder))
    return v.select("country", "ch", "feat", "df", F.round("idf", 6).alias("idf"))


@query(f"{_BASE}, {_search_sql(['nw'], CAPS, 'a')}, {_best_sql(['nw'], 'a', 3, 0)} SELECT * FROM best_a")
def name_words_topk(spark, folder):
    return _search(spark, folder, {"nw": CAPS["nw"]}, 3, 0)


@query(f"{_BASE}, {_search_sql(['nc'], CAPS, 'a')}, {_best_sql(['nc'], 'a', 3, 0)} SELECT * FROM best_a")
def char4_topk(spark, folder):
    return _search(spark, folder, {"nc": CAPS["nc"]}, 3, 0)


@query(f"{_BASE}, {_search_sql(_CH, CAPS, 'a')}, {_best_sql(_CH, 'a', 20, 3)} SELECT * FROM best_a")
def multi_channel_topk(spark, folder):
    return _search(spark, folder, CAPS, 20, 3)


@query(f"""{_BASE}, {_search_sql(_CH, _LOW, 'a')}, {_best_sql(_CH, 'a', 20, 3)},
weak AS (SELECT r.id FROM (SELECT DISTINCT id FROM simple WHERE src > 1) r LEFT JOIN (SELECT q, max(comb) AS best FROM best_a GROUP BY q) b ON b.q = r.id WHERE coalesce(best, 0.0) < 1.5),
{_search_sql(_CH, _WIDE, 'b', 'AND f.id IN (SELECT id FROM weak)')}, {_best_sql(_CH, 'b', 20, 3)}
SELECT * FROM best_a WHERE q NOT IN (SELECT id FROM weak) UNION ALL SELECT * FROM best_b""")
def adaptive_second_pass(spark, folder):
    return _search(spark, folder, _LOW, 20, 3, _WIDE)


@query(f"{_BASE}, {_search_sql(_CH, CAPS, 'a')}, {_best_sql(_CH, 'a', 20, 3)} SELECT q, s, comb FROM best_a QUALIFY row_number() OVER (PARTITION BY q ORDER BY comb DESC, s) = 1")
def assign_best(spark, folder):
    # The best of a query's best pairs is its first; only those are exchanged, for ids that stand in several countries.
    return B.assign(_search(spark, folder, CAPS, 1, 0)).select("q", "s", "comb")


@query(f"WITH {_PAIRS}, {_TRUTH}, reached AS (SELECT t.q, t.s, r FROM truth t LEFT JOIN (SELECT q, s, min(rk) AS r FROM pairs GROUP BY q, s) p ON p.q = t.q AND p.s = t.s) SELECT CAST(k AS INT) AS k, count(*) AS n_true, count_if(r < k) AS n_found, round(count_if(r < k) / count(*), 6) AS recall FROM reached CROSS JOIN (VALUES (1), (3), (7), (20)) x(k) GROUP BY k")
def blocking_recall(spark, folder):
    return M.blocking_recall(pairs(spark, folder), truth(spark, folder), "rk", [1, 3, 7, 20])


# ------------------------------------------------------------------ context


def _margin_sql(c: str) -> str:
    return f"""rank() OVER (PARTITION BY q ORDER BY {c} DESC) AS rank_{c}, round({c} - coalesce(CASE WHEN {c} = max({c}) OVER (PARTITION BY q) THEN nth_value({c}, 2) OVER (PARTITION BY q ORDER BY {c} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE max({c}) OVER (PARTITION BY q) END, 0.0), 6) AS margin_{c}"""


@query(f"WITH {_PAIRS} SELECT q, s, count(*) OVER (PARTITION BY q) AS n_q, {', '.join(_margin_sql(c) for c in ('sc_nw', 'sc_nc', 'comb'))} FROM pairs")
def margin_and_rank(spark, folder):
    scores = ["sc_nw", "sc_nc", "comb"]
    out = C.ranks_and_margins(pairs(spark, folder), scores)
    return out.select("q", "s", "n_q", *[x for c in scores for x in (F.col(f"rank_{c}"), F.round(f"margin_{c}", 6).alias(f"margin_{c}"))])


@query(f"WITH {_PAIRS} SELECT q, s, round(comb - max(comb) OVER (PARTITION BY q), 6) AS gap_comb, round(max(sc_nw) OVER (PARTITION BY q) - sc_nw, 6) AS gap_sc_nw FROM pairs")
def stage0_signals(spark, folder):
    out = C.gaps(pairs(spark, folder), "comb", ["sc_nw"])
    return out.select("q", "s", F.round("gap_comb", 6).alias("gap_comb"), F.round("gap_sc_nw", 6).alias("gap_sc_nw"))


@query(f"""WITH {_PAIRS}, a AS (SELECT q, s, p, row_number() OVER w AS q_rank, sum(p) OVER (PARTITION BY q) AS q_sum, count(*) OVER (PARTITION BY q) AS q_n, max(p) OVER (PARTITION BY q) AS f,
nth_value(p, 2) OVER (PARTITION BY q ORDER BY p DESC, s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS g FROM pairs WINDOW w AS (PARTITION BY q ORDER BY p DESC, s)),
b AS (SELECT *, coalesce(CASE WHEN q_rank = 1 THEN g ELSE f END, 0.0) AS q_max_other, CASE WHEN q_rank = 1 AND p >= 0.5 THEN 1 ELSE 0 END AS st, CASE WHEN q_rank = 1 THEN p ELSE 0.0 END AS bp, row_number() OVER (PARTITION BY s ORDER BY p DESC, q) AS sr, max(p) OVER (PARTITION BY s) AS top1 FROM a),
c AS (SELECT *, max(CASE WHEN sr = 2 THEN p END) OVER (PARTITION BY s) AS second FROM b)
SELECT q, s, q_rank, q_n, round(q_sum, 6) AS q_sum, round(q_max_other, 6) AS q_max_other, count(*) OVER (PARTITION BY s) AS s_n, CAST(sum(st) OVER (PARTITION BY s) - st AS BIGINT) AS s_strong_others,
round(sum(bp) OVER (PARTITION BY s) - bp, 5) AS s_best_sum_others, round(sum(p) OVER (PARTITION BY s) - p, 5) AS s_sum_others, round(coalesce(CASE WHEN p >= top1 THEN second ELSE top1 END, 0.0), 6) AS s_max_other FROM c""")
def stage2_context(spark, folder):
    out = C.stage_two(pairs(spark, folder).select("q", "s", "p"))
    return out.select("q", "s", "q_rank", "q_n", F.round("q_sum", 6).alias("q_sum"), F.round("q_max_other", 6).alias("q_max_other"), "s_n", F.col("s_strong_others").cast("long").alias("s_strong_others"),
                      F.round("s_best_sum_others", 5).alias("s_best_sum_others"), F.round("s_sum_others", 5).alias("s_sum_others"), F.round("s_max_other", 6).alias("s_max_other"))


@query(f"""WITH {_PAIRS}, a AS (SELECT s, p, row_number() OVER (PARTITION BY q ORDER BY p DESC, s) = 1 AS is_best FROM pairs)
SELECT s, count(*) AS s_n, CAST(sum(CASE WHEN is_best AND p >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS s_strong, round(sum(CASE WHEN is_best THEN p ELSE 0.0 END), 5) AS s_best_sum, round(sum(p), 5) AS s_sum, round(max(p), 6) AS s_top1,
round(coalesce(list_sort(list(p), 'DESC')[2], 0.0), 6) AS s_top2 FROM a GROUP BY s""")
def entity_aggregates(spark, folder):
    from pyspark.sql.window import Window

    best = F.row_number().over(Window.partitionBy("q").orderBy(F.col("p").desc(), F.col("s"))) == 1
    out = C.entity_aggregates(pairs(spark, folder).withColumn("is_best", best))
    return out.select("s", "s_n", "s_strong", *[F.round(c, d).alias(c) for c, d in (("s_best_sum", 5), ("s_sum", 5), ("s_top1", 6), ("s_top2", 6))])


@query(f"""{_ALL}, k AS (SELECT q, s, q_nums[1] AS num, nullif(array_to_string(list_sort(q_nw), ' '), '') AS nm FROM sides)
SELECT q, s, CAST(CASE WHEN num IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY s, num) - 1 END AS BIGINT) AS same_number, CAST(CASE WHEN nm IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY s, nm) - 1 END AS BIGINT) AS same_name FROM k""")
def group_support(spark, folder):
    r = with_heads(spark, folder)
    named = simple_form(r.where("src > 1")).select(F.col("id").alias("q"), F.try_element_at("nums", F.lit(1)).alias("num"), F.nullif(F.array_join(F.array_sort("nw"), " "), F.lit("")).alias("nm"))
    # No label is asked here, so neither truth nor the entity's words are carried through the exchanges.
    keyed = pairs(spark, folder).select("q", "s").join(r.where("src <= 1").select(F.col("entity_id").alias("s")), "s").join(named, "q")
    return C.support(keyed, "s", {"same_number": "num", "same_name": "nm"}).select("q", "s", "same_number", "same_name")
