"""Pair features, learned statistics, decisions and models as queries, with the SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import normalise as N
from weftline.functions.similarity import all_scores, edit_similarity, jaro_winkler, scorer
from weftline.operators import context as C
from weftline.operators import decide as D
from weftline.operators import metrics as M
from weftline.operators import model as G
from weftline.operators import pair_features as P
from weftline.operators import risk as R
from weftline.operators.sampling import sample_keys, sample_rows
from weftline.operators.transliteration import learn
from weftline.plans.linking import SQL as PARTS_SQL
from weftline.plans.linking import _ALL, _ENTITIES, _PAIRS, _RECORDS, _SIMPLE, _TRUTH, _WITH_HEADS, _quoted, entities, pairs, records, sides, simple, simple_form, truth, with_heads
from weftline.session import cut
from weftline.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# ------------------------------------------------------------------ pair features


@query(f"""{_ALL} SELECT q, s, CAST(len(list_filter(q_nw, lambda t: NOT list_contains(s_nw, t))) AS INT) AS n_extra, CAST(len(list_filter(s_nw, lambda t: NOT list_contains(q_nw, t))) AS INT) AS n_missing,
array_to_string(list_filter(q_nw, lambda t: NOT list_contains(s_nw, t)), ' ') AS extra, len(list_filter(q_nw, lambda t: NOT list_contains(s_nw, t))) = 0 AS q_within_s FROM sides""")
def token_extra_missing(spark, folder):
    extra, missing = P.extra_tokens(F.col("q_nw"), F.col("s_nw")), P.extra_tokens(F.col("s_nw"), F.col("q_nw"))
    return sides(spark, folder).select("q", "s", F.size(extra).alias("n_extra"), F.size(missing).alias("n_missing"), F.array_join(extra, " ").alias("extra"), (F.size(F.array_except("q_nw", "s_nw")) == 0).alias("q_within_s"))


_WEIGHTS = """names AS (SELECT coalesce(country, '') AS country, count(DISTINCT entity_id) AS n_index FROM source1 GROUP BY 1),
tokens AS (SELECT id, src, country, unnest(nw) AS t FROM simple),
voc AS (SELECT k.country, t, count(DISTINCT id) AS df, ln((any_value(n_index) + 1) / (count(DISTINCT id) + 0.5)) AS idf FROM tokens k JOIN names n ON n.country = k.country WHERE src = 1 GROUP BY k.country, t),
uns AS (SELECT country, ln((n_index + 1) / 0.5) AS idf FROM names),
wt AS (SELECT k.id, k.src, k.t, coalesce(v.idf, u.idf, 0.0) AS idf, coalesce(v.df, 0) AS df FROM tokens k LEFT JOIN voc v ON v.country = k.country AND v.t = k.t LEFT JOIN uns u ON u.country = k.country)"""


def weighted_sides(spark, folder):
    """sides with arrays of struct(t, idf, df) q_w and s_w; df counts source1 alone, as the index does, and chain heads are weighed by it."""
    r = simple_form(with_heads(spark, folder))
    size = table(spark, folder, "source1").groupBy(F.coalesce("country", F.lit("")).alias("country")).agg(F.countDistinct("entity_id").alias("n_index"))
    each = r.select("id", "src", "country", F.explode("nw").alias("t"))
    df = each.where("src = 1").groupBy("country", "t").agg(F.countDistinct("id").alias("df")).join(size, "country")
    vocab = df.select("country", "t", "df", F.log((F.col("n_index") + 1) / (F.col("df") + 0.5)).alias("idf"))
    unseen = size.select("country", F.log((F.col("n_index") + 1) / 0.5).alias("top"))
    weighed = each.join(vocab, ["country", "t"], "left").join(unseen, "country", "left")
    arrays = cut(weighed.groupBy("id", "src").agg(F.sort_array(F.collect_list(F.struct("t", F.coalesce("idf", "top", F.lit(0.0)).alias("idf"), F.coalesce("df", F.lit(0)).alias("df")))).alias("w")))
    q, s = arrays.where("src > 1").select(F.col("id").alias("q"), F.col("w").alias("q_w")), arrays.where("src <= 1").select(F.col("id").alias("s"), F.col("w").alias("s_w"))
    empty = F.array().cast("array<struct<t:string,idf:double,df:bigint>>")
    met = sides(spark, folder).join(q, "q", "left").join(s, "s", "left")
    return met.withColumns({"q_w": F.coalesce("q_w", empty), "s_w": F.coalesce("s_w", empty)})


@query(f"""{_ALL}, {_WEIGHTS}, qt AS (SELECT d.q, d.s, w.t, w.idf, w.df FROM sides d JOIN wt w ON w.id = d.q AND w.src > 1), st AS (SELECT d.q, d.s, w.t, w.idf FROM sides d JOIN wt w ON w.id = d.s AND w.src <= 1),
fo AS (SELECT coalesce(a.q, b.q) AS q, coalesce(a.s, b.s) AS s, a.idf AS qi, b.idf AS si FROM qt a FULL JOIN st b ON a.q = b.q AND a.s = b.s AND a.t = b.t),
g AS (SELECT q, s, sum(CASE WHEN si IS NOT NULL THEN qi END) AS mass, sum(qi) AS qm, sum(si) AS sm, count(CASE WHEN si IS NOT NULL THEN qi END) AS shared, count(qi) AS ql, count(si) AS sl, max(CASE WHEN si IS NULL THEN qi END) AS me, max(CASE WHEN qi IS NULL THEN si END) AS mm FROM fo GROUP BY q, s)
SELECT d.q, d.s, CASE WHEN ql > 0 AND sl > 0 THEN round(coalesce(mass, 0.0) / qm, 6) ELSE -1.0 END AS nm_q_cover, CASE WHEN ql > 0 AND sl > 0 THEN round(coalesce(mass, 0.0) / sm, 6) ELSE -1.0 END AS nm_s_cover, round(coalesce(mass, 0.0), 6) AS nm_mass, CAST(coalesce(shared, 0) AS INT) AS nm_shared,
round(coalesce(me, 0.0), 6) AS nm_max_extra, round(coalesce(mm, 0.0), 6) AS nm_max_missing, CAST(coalesce(ql, 0) AS INT) AS nm_q_len, CAST(coalesce(sl, 0) AS INT) AS nm_s_len FROM sides d LEFT JOIN g ON g.q = d.q AND g.s = d.s""")
def idf_overlap(spark, folder):
    return weighted_sides(spark, folder).select("q", "s", *[c.alias(n) for n, c in P.overlap(F.col("q_w"), F.col("s_w"), "nm").items()])


@query(f"""WITH {_RECORDS}, {_SIMPLE}, {_WEIGHTS} SELECT r.id, CASE WHEN n > 0 THEN round(z / n, 6) ELSE -1.0 END AS oov_share, CAST(coalesce(z, 0) AS INT) AS oov_n FROM (SELECT id FROM simple WHERE src > 1) r
LEFT JOIN (SELECT id, count(*) AS n, count_if(df = 0) AS z FROM wt WHERE src > 1 GROUP BY id) w ON w.id = r.id""")
def out_of_vocabulary(spark, folder):
    r = simple(spark, folder)
    each = r.select("id", "src", "country", F.explode("nw").alias("t"))
    df = each.where("src = 1").groupBy("country", "t").agg(F.countDistinct("id").alias("df"))
    w = each.where("src > 1").join(df, ["country", "t"], "left").groupBy("id").agg(F.collect_list(F.struct("t", "df")).alias("w"))
    met = r.where("src > 1").select("id").join(w, "id", "left").withColumn("w", F.coalesce("w", F.array().cast("array<struct<t:string,df:bigint>>")))
    return met.select("id", *[c.alias(n) for n, c in P.unseen_share(F.col("w")).items()])


_QL, _SL = "list_transform(q_nums, lambda n: CAST(substring(n, 1, 18) AS BIGINT))", "list_transform(s_nums, lambda n: CAST(substring(n, 1, 18) AS BIGINT))"
_LEN = "length(CAST({} AS VARCHAR))"


@query(f"""{_ALL}, n AS (SELECT q, s, {_QL} AS qn, {_SL} AS sn, len(q_nums) AS a, len(s_nums) AS b FROM sides), m AS (SELECT *, a > 0 AND b > 0 AS ok, sn[1] AS f, len(list_filter(sn, lambda x: list_contains(qn, x))) AS met FROM n)
SELECT q, s, CAST(a AS INT) AS num_q, CAST(b AS INT) AS num_s, CASE WHEN ok THEN CAST(list_contains(qn, f) AS INT) ELSE -1 END AS num_s0_in_q, CASE WHEN ok THEN CAST(qn[1] = f AS INT) ELSE -1 END AS num_first_eq,
CAST(CASE WHEN ok THEN list_min(list_transform(qn, lambda x: levenshtein(CAST(x AS VARCHAR), CAST(f AS VARCHAR)))) ELSE -1 END AS INT) AS num_best_ed,
CASE WHEN ok THEN round(list_min(list_transform(qn, lambda x: abs(x - f) / greatest(1.0::DOUBLE, f::DOUBLE))), 6) ELSE -1.0 END AS num_best_rel,
CASE WHEN ok THEN round(ln(1.0::DOUBLE + list_min(list_transform(qn, lambda x: abs(x - f)))), 6) ELSE -1.0 END AS num_min_diff, CASE WHEN ok THEN round(ln(1.0::DOUBLE + abs(qn[1] - f)), 6) ELSE -1.0 END AS num_first_abs,
CASE WHEN ok THEN CAST(len(list_filter(qn, lambda x: x <> f AND (starts_with(CAST(f AS VARCHAR), CAST(x AS VARCHAR)) OR starts_with(CAST(x AS VARCHAR), CAST(f AS VARCHAR))))) > 0 AS INT) ELSE -1 END AS num_prefix,
CASE WHEN ok THEN round(met / (a + b - met), 6) ELSE -1.0 END AS num_jacc, CAST(CASE WHEN ok THEN {_LEN.format('f')} - {_LEN.format('qn[1]')} ELSE -1 END AS INT) AS num_len_diff FROM m""")
def number_features(spark, folder):
    return sides(spark, folder).select("q", "s", *[c.alias(n) for n, c in P.number_features(F.col("q_nums"), F.col("s_nums")).items()])


def _legal_sql(c: str) -> str:
    ranks = " ".join(f"WHEN '{w}' THEN {i}" for i, w in enumerate(P.LEGAL_RANK, 1))
    return f"coalesce(list_min(list_transform({c}, lambda t: CASE t {ranks} END)), 0)"


_LEGAL = f"lg AS (SELECT q, s, y, country, {_legal_sql('q_nw')} AS lq, {_legal_sql('s_nw')} AS ls FROM sides), lr AS (SELECT *, CASE WHEN lq = 0 AND ls = 0 THEN 0 WHEN ls = 0 THEN 1 WHEN lq = 0 THEN 2 WHEN lq = ls THEN 3 ELSE 4 END AS relation FROM lg)"


def _legal(spark, folder):
    coded = sides(spark, folder).select("q", "s", "y", "country", P.legal_code(F.col("q_nw")).alias("lq"), P.legal_code(F.col("s_nw")).alias("ls"))
    return coded.withColumn("relation", P.legal_relation(F.col("lq"), F.col("ls")))


@query(f"{_ALL}, {_LEGAL} SELECT q, s, CAST(lq AS INT) AS lq, CAST(ls AS INT) AS ls, CAST(relation AS INT) AS relation FROM lr")
def legal_relation(spark, folder):
    return _legal(spark, folder).select("q", "s", "lq", "ls", "relation")


_NAMES = f"""WITH {_WITH_HEADS}, {_PAIRS}, nm AS (SELECT p.q, p.s, lower(coalesce(a.business_name, '')) AS a, lower(coalesce(b.business_name, '')) AS b FROM pairs p JOIN records a ON a.entity_id = p.q AND a.src > 1 JOIN records b ON b.entity_id = p.s AND b.src <= 1)"""


def _names(spark, folder):
    r = with_heads(spark, folder)
    q, s = r.where("src > 1").select(F.col("entity_id").alias("q"), F.lower(F.coalesce("business_name", F.lit(""))).alias("a")), r.where("src <= 1").select(F.col("entity_id").alias("s"), F.lower(F.coalesce("business_name", F.lit(""))).alias("b"))
    return pairs(spark, folder).select("q", "s").join(q, "q").join(s, "s")


@query(_NAMES.replace("lower(coalesce(a.business_name, ''))", "regexp_replace(lower(coalesce(a.business_name, '')), '[^\\x00-\\x7f]', '', 'g')").replace("lower(coalesce(b.business_name, ''))", "regexp_replace(lower(coalesce(b.business_name, '')), '[^\\x00-\\x7f]', '', 'g')") + " SELECT q, s, round(1.0 - levenshtein(a, b) / greatest(length(a), length(b), 1), 6) AS similarity FROM nm")
def edit_similarity_pairs(spark, folder):
    ascii_ = lambda c: F.regexp_replace(c, "[^\\x00-\\x7f]", "")
    return _names(spark, folder).select("q", "s", F.round(edit_similarity(ascii_("a"), ascii_("b")), 6).alias("similarity"))


@query(_NAMES.replace("lower(coalesce(a.business_name, ''))", "regexp_replace(lower(coalesce(a.business_name, '')), '[^\\x00-\\x7f]', '', 'g')").replace("lower(coalesce(b.business_name, ''))", "regexp_replace(lower(coalesce(b.business_name, '')), '[^\\x00-\\x7f]', '', 'g')") + " SELECT q, s, round(CASE WHEN a = b THEN 1.0 ELSE jaro_winkler_similarity(a, b) END, 6) AS similarity FROM nm")
def jaro_winkler_pairs(spark, folder):
    ascii_ = lambda c: F.regexp_replace(c, "[^\\x00-\\x7f]", "")
    return _names(spark, folder).select("q", "s", F.round(scorer(jaro_winkler)(ascii_("a"), ascii_("b")), 6).alias("similarity"))


@query()
def string_scores(spark, folder):
    """Indel, token-sort, token-set, partial ratio and Jaro-Winkler of the names of every candidate pair."""
    named = _names(spark, folder).select("q", "s", N.fold_latin(F.col("a")).alias("a"), N.fold_latin(F.col("b")).alias("b"))
    # Scoring a pair costs less than finding out which pairs are spelled alike.
    scored = named.select("q", "s", all_scores(F.col("a"), F.col("b")).alias("r"))
    return scored.select("q", "s", *[F.round(f"r.{n}", 6).alias(n) for n in ("ratio", "token_sort", "token_set", "partial", "jaro_winkler")])


# ------------------------------------------------------------------ learned statistics

_RISK = """known AS (SELECT * FROM sides WHERE y IS NOT NULL), ex AS (SELECT country, y, unnest(list_filter(q_nw, lambda t: NOT list_contains(s_nw, t))) AS t FROM known), mi AS (SELECT country, y, unnest(list_filter(s_nw, lambda t: NOT list_contains(q_nw, t))) AS t FROM known),
tot AS (SELECT country, count_if(y = 1) AS n_pos, count_if(y = 0) AS n_neg FROM known GROUP BY country),
exc AS (SELECT country, t, count_if(y = 1) AS p, count_if(y = 0) AS n FROM ex GROUP BY country, t), mic AS (SELECT country, t, count_if(y = 1) AS p, count_if(y = 0) AS n FROM mi GROUP BY country, t),
bo AS (SELECT coalesce(a.country, b.country) AS country, coalesce(a.t, b.t) AS t, coalesce(a.p, 0) AS ep, coalesce(a.n, 0) AS en, coalesce(b.p, 0) AS mp, coalesce(b.n, 0) AS mn FROM exc a FULL JOIN mic b ON a.country = b.country AND a.t = b.t),
risk AS (SELECT bo.country, t, ep AS n_extra_pos, en AS n_extra_neg, mp AS n_miss_pos, mn AS n_miss_neg, round(CASE WHEN ep + en > 0 THEN ln(((en + 1) / (n_neg + 2)) / ((ep + 1) / (n_pos + 2))) ELSE 0.0 END, 6) AS r_extra,
 round(CASE WHEN mp + mn > 0 THEN ln(((mn + 1) / (n_neg + 2)) / ((mp + 1) / (n_pos + 2))) ELSE 0.0 END, 6) AS r_miss FROM bo JOIN tot ON tot.country = bo.country)"""


def _risks(known):
    return R.token_risk(known, "q_nw", "s_nw", "y")


@query(f"{_ALL}, {_RISK} SELECT * FROM risk")
def token_risk(spark, folder):
    return _risks(cut(sides(spark, folder).where("y is not null")))


@query(f"""{_ALL}, {_RISK}, pe AS (SELECT q, s, max(coalesce(r_extra, 0.0)) AS mx, sum(coalesce(r_extra, 0.0)) AS sm, count(*) AS n FROM (SELECT q, s, country, unnest(list_filter(q_nw, lambda t: NOT list_contains(s_nw, t))) AS t FROM sides) x LEFT JOIN risk r ON r.country = x.country AND r.t = x.t GROUP BY q, s),
pm AS (SELECT q, s, max(coalesce(r_miss, 0.0)) AS mx, sum(coalesce(r_miss, 0.0)) AS sm FROM (SELECT q, s, country, unnest(list_filter(s_nw, lambda t: NOT list_contains(q_nw, t))) AS t FROM sides) x LEFT JOIN risk r ON r.country = x.country AND r.t = x.t GROUP BY q, s)
SELECT d.q, d.s, coalesce(pe.mx, -99.0) AS max_extra, round(coalesce(pe.sm, 0.0), 6) AS sum_extra, coalesce(pe.n, 0) AS n_extra, coalesce(pm.mx, -99.0) AS max_miss, round(coalesce(pm.sm, 0.0), 6) AS sum_miss FROM sides d LEFT JOIN pe ON pe.q = d.q AND pe.s = d.s LEFT JOIN pm ON pm.q = d.q AND pm.s = d.s""")
def pair_risk(spark, folder):
    every = cut(sides(spark, folder).select("q", "s", "country", "q_nw", "s_nw", "y"))
    return R.pair_risk(every, _risks(every.where("y is not null")), "q_nw", "s_nw", ["q", "s"])


@query(f"""{_ALL}, {_LEGAL}, kn AS (SELECT * FROM lr WHERE y IS NOT NULL), ce AS (SELECT lq, ls, relation, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM kn GROUP BY 1, 2, 3), re AS (SELECT relation, count_if(y = 1) AS rp, count_if(y = 0) AS rn FROM kn GROUP BY 1)
SELECT CAST(lq AS INT) AS lq, CAST(ls AS INT) AS ls, CAST(ce.relation AS INT) AS relation, pos + neg AS n, round(CASE WHEN pos + neg >= 20 THEN ln((neg + 1) / (pos + 1)) ELSE ln((rn + 1) / (rp + 1)) END, 6) AS risk FROM ce JOIN re ON re.relation = ce.relation""")
def legal_risk(spark, folder):
    return R.legal_risk(cut(_legal(spark, folder).where("y is not null")), "lq", "ls", "relation", "y")


@query(f"""{_ALL}, {_RISK}, {_WEIGHTS}, rk AS (SELECT * FROM risk WHERE country <> 'India'), le AS (SELECT v.country, v.t, v.df, r_extra FROM voc v JOIN rk r ON r.country = v.country AND r.t = v.t),
po AS (SELECT t, avg(r_extra) AS mean FROM le WHERE df >= 20 GROUP BY t), md AS (SELECT median(r_extra) AS middle FROM le WHERE df >= 100), kc AS (SELECT DISTINCT country FROM rk)
SELECT v.country, v.t, v.df, round(CASE WHEN kc.country IS NOT NULL THEN coalesce(r.r_extra, 0.0) ELSE coalesce(mean, middle, 0.0) END, 6) AS risk FROM voc v LEFT JOIN rk r ON r.country = v.country AND r.t = v.t LEFT JOIN kc ON kc.country = v.country LEFT JOIN po ON po.t = v.t CROSS JOIN md""")
def risk_back_off(spark, folder):
    """Leave-one-country-out: India is treated as unlabelled."""
    risks = cut(_risks(cut(sides(spark, folder).where("y is not null")))).where("country <> 'India'")
    vocab = simple(spark, folder).where("src = 1").select("id", "country", F.explode("nw").alias("t")).groupBy("country", "t").agg(F.countDistinct("id").alias("df"))
    known = table(spark, folder, "source1").select(F.coalesce("country", F.lit("")).alias("country")).distinct()
    return R.back_off(vocab.join(known, "country", "left_semi"), risks)


_ONE = "oneoff AS (SELECT q, s, country, list_filter(q_nw, lambda t: NOT list_contains(s_nw, t)) AS x, q_nums[1] = s_nums[1] AS hit FROM sides WHERE len(q_nums) > 0 AND len(s_nums) > 0), single AS (SELECT q, s, country, x[1] AS t, hit FROM oneoff WHERE len(x) = 1), mu AS (SELECT avg(CAST(hit AS DOUBLE)) AS mu FROM single), ag AS (SELECT country, t, count(*) AS n, round((count_if(hit) + 20.0 * any_value(mu)) / (count(*) + 20.0), 6) AS rate FROM single, mu GROUP BY country, t)"


def _agreement(spark, folder):
    """Rows of pairs that differ by one extra token: does the house number agree?"""
    both = sides(spark, folder).where((F.size("q_nums") > 0) & (F.size("s_nums") > 0))
    x = both.select("q", "s", "country", P.extra_tokens(F.col("q_nw"), F.col("s_nw")).alias("x"), (F.try_element_at("q_nums", F.lit(1)) == F.try_element_at("s_nums", F.lit(1))).alias("hit"))
    return x.where(F.size("x") == 1).select("q", "s", "country", F.try_element_at("x", F.lit(1)).alias("t"), "hit")


@query(f"{_ALL}, {_ONE} SELECT * FROM ag")
def agreement_rate(spark, folder):
    return R.shrunk_rate(cut(_agreement(spark, folder)), ["country", "t"], F.col("hit"))


@query(f"""{_ALL}, {_ONE}, each AS (SELECT q, s, country, unnest(list_filter(q_nw, lambda t: NOT list_contains(s_nw, t))) AS t FROM sides)
SELECT e.q, e.s, min(rate) AS min_rate, arg_min(n, (rate, n)) AS support FROM each e JOIN ag ON ag.country = e.country AND ag.t = e.t GROUP BY e.q, e.s""")
def pair_agreement(spark, folder):
    """The least agreement rate among a pair's extra tokens and its support."""
    rates = cut(R.shrunk_rate(cut(_agreement(spark, folder)), ["country", "t"], F.col("hit")))
    each = sides(spark, folder).select("q", "s", "country", F.explode(P.extra_tokens(F.col("q_nw"), F.col("s_nw"))).alias("t"))
    return each.join(rates, ["country", "t"]).groupBy("q", "s").agg(F.min(F.struct("rate", "n")).alias("m")).select("q", "s", F.col("m.rate").alias("min_rate"), F.col("m.n").alias("support"))


@query("SELECT event_type, count(*) AS n, round((count_if(value > 50) + 20.0 * (SELECT avg(CAST(value > 50 AS DOUBLE)) FROM events)) / (count(*) + 20.0), 6) AS rate FROM events GROUP BY event_type")
def shrunk_rate(spark, folder):
    return R.shrunk_rate(table(spark, folder, "events"), ["event_type"], F.coalesce(F.col("value") > 50, F.lit(False)))


@query("SELECT CAST(((o_custkey * 2654435761) >> 7) % 2 AS BIGINT) AS fold, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def crossfit_folds(spark, folder):
    return table(spark, folder, "orders").groupBy(C.fold("o_custkey").alias("fold"), "o_orderstatus").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ decisions and metrics

_BEST = "best AS (SELECT q, s, p FROM pairs QUALIFY row_number() OVER (PARTITION BY q ORDER BY p DESC, s) = 1)"
_ENT = "ent AS (SELECT DISTINCT entity_id AS s, country FROM source1 WHERE data_split = 'train'), tr AS (SELECT t.q, t.s FROM truth t JOIN ent e ON e.s = t.s), pr AS (SELECT b.* FROM best b JOIN ent e ON e.s = b.s)"
_F = "CASE WHEN coalesce(n_true, 0) = 0 THEN CAST(coalesce(n_pred, 0) = 0 AS DOUBLE) WHEN coalesce(hit, 0) = 0 THEN 0.0 ELSE 1.25 * hit / (0.25 * n_true + n_pred) END"


def _best(spark, folder):
    order = Window.partitionBy("q").orderBy(F.col("p").desc(), F.col("s"))
    return pairs(spark, folder).select("q", "s", "p").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def _judged(spark, folder):
    ent = table(spark, folder, "source1").where("data_split = 'train'").select(F.col("entity_id").alias("s"), "country").distinct()
    return _best(spark, folder).join(ent.select("s"), "s"), truth(spark, folder).join(ent.select("s"), "s"), ent


@query(f"""WITH {_PAIRS}, {_TRUTH}, {_BEST}, {_ENT}, pd AS (SELECT * FROM pr WHERE p >= 0.5), f AS (SELECT {_F} AS f FROM ent e LEFT JOIN (SELECT s, count(*) AS n_true FROM tr GROUP BY s) t ON t.s = e.s LEFT JOIN (SELECT s, count(*) AS n_pred FROM pd GROUP BY s) n ON n.s = e.s
LEFT JOIN (SELECT pd.s, count(*) AS hit FROM pd JOIN tr ON tr.q = pd.q AND tr.s = pd.s GROUP BY pd.s) h ON h.s = e.s) SELECT count(*) AS n_entities, round(avg(f), 6) AS macro_f05 FROM f""")
def macro_f05(spark, folder):
    pred, true, ent = _judged(spark, folder)
    return M.macro_f(pred.where("p >= 0.5"), true, ent)


_THR = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


@query(f"""WITH {_PAIRS}, {_TRUTH}, {_BEST}, {_ENT}, th AS (SELECT CAST(unnest({_THR}) AS DOUBLE) AS thr), hp AS (SELECT thr, pr.s, count(*) AS n_pred, count(tr.q) AS hit FROM pr JOIN th ON pr.p >= thr LEFT JOIN tr ON tr.q = pr.q AND tr.s = pr.s GROUP BY thr, pr.s),
f AS (SELECT th.thr, country, {_F} AS f FROM ent e CROSS JOIN th LEFT JOIN (SELECT s, count(*) AS n_true FROM tr GROUP BY s) t ON t.s = e.s LEFT JOIN hp ON hp.s = e.s AND hp.thr = th.thr)
SELECT thr, country, count(*) AS n, round(avg(f), 6) AS macro_f05 FROM f GROUP BY GROUPING SETS ((thr), (thr, country))""")
def threshold_sweep(spark, folder):
    pred, true, ent = _judged(spark, folder)
    return M.threshold_sweep(pred, true, ent, _THR)


@query(f"""WITH {_PAIRS}, {_BEST}, l AS (SELECT s, list_sort(list(p)) AS ps, count(*) AS n FROM best GROUP BY s)
SELECT s, CAST(n AS BIGINT) AS n, round(list_reduce(list_prepend(CAST(1.0 AS DOUBLE), ps), lambda a, x: a * (1 - x)), 6) AS p_none, round(list_sum(ps), 6) AS mean FROM l""")
def poisson_binomial(spark, folder):
    """Per entity the chance that none of its queries belongs to it and the expected number, whatever its size: products and sums, no list of its pairs."""
    return D.none_and_mean(_best(spark, folder), "s").select("s", "n", F.round("p_none", 6).alias("p_none"), F.round("mean", 6).alias("mean"))


# The distribution of a list of p, one trial a step.
_PMF = "list_reduce(list_prepend([1.0::DOUBLE], list_transform({0}, lambda z: [z])), lambda f, x: list_transform(range(1, len(f) + 2), lambda i: coalesce(f[i], 0.0) * (1 - x[1]) + CASE WHEN i > 1 THEN f[i - 1] ELSE 0.0 END * x[1]))"


@query(f"""WITH {_PAIRS}, {_BEST}, live AS (SELECT s, q, p, count(*) OVER (PARTITION BY s) AS n, row_number() OVER (PARTITION BY s ORDER BY p DESC, q) AS r FROM best WHERE p >= 0.05),
g AS (SELECT s, list(p ORDER BY p DESC) AS ps, CAST(any_value(n) AS INT) AS n FROM live WHERE n <= 40 GROUP BY s), ks AS (SELECT s, ps, n, unnest(range(1, n + 1)) AS k FROM g),
d AS (SELECT s, n, k, {_PMF.format('ps[1:k]')} AS fx, {_PMF.format('ps[k + 1:]')} AS fy FROM ks),
v AS (SELECT s, k, list_sum(list_transform(range(1, k + 1), lambda h: list_sum(list_transform(range(0, n - k + 1), lambda m: fx[h + 1] * fy[m + 1] * 1.25 * h / (0.25 * (h + m) + k))))) AS value FROM d
 UNION ALL SELECT s, 0, list_product(list_transform(ps, lambda z: 1 - z)) FROM g),
b AS (SELECT s, k FROM v QUALIFY row_number() OVER (PARTITION BY s ORDER BY round(value, 11) DESC, k) = 1)
SELECT live.q, live.s, round(live.p, 6) AS p FROM live LEFT JOIN b ON b.s = live.s WHERE CASE WHEN n <= 40 THEN r <= b.k ELSE live.p >= 0.5 END""")
def expected_f_keep(spark, folder):
    return D.expected_f_keep(_best(spark, folder)).select("q", "s", F.round("p", 6).alias("p"))


@query(f"""WITH {_PAIRS}, u AS (SELECT q, s, sc_nw AS p FROM pairs UNION ALL SELECT q, s, sc_nc FROM pairs UNION ALL SELECT q, s, p FROM pairs)
SELECT q, s, round(1.0 / (1.0 + exp(-avg(ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p))))))), 6) AS p, round(avg(p), 6) AS p_mean FROM u WHERE p IS NOT NULL GROUP BY q, s""")
def logit_mean(spark, folder):
    p = pairs(spark, folder)
    every = p.select("q", "s", F.col("sc_nw").alias("p")).unionByName(p.select("q", "s", F.col("sc_nc").alias("p"))).unionByName(p.select("q", "s", "p")).where("p is not null")
    return every.groupBy("q", "s").agg(F.round(D.logit_mean(F.col("p")), 6).alias("p"), F.round(F.avg("p"), 6).alias("p_mean"))


@query(f"""WITH {_PAIRS}, e AS (SELECT entity_id AS s, country FROM {_ENTITIES}) SELECT p.q, p.s, country, round(CASE WHEN country = 'France' THEN sc_nc ELSE p.p END, 6) AS p FROM pairs p JOIN e ON e.s = p.s""")
def merge_preds(spark, folder):
    every = pairs(spark, folder).join(entities(spark, folder).select(F.col("entity_id").alias("s"), "country"), "s")
    out = D.merge_by_country(every.select("q", "s", "country", "p"), every.select("q", "s", F.col("sc_nc").alias("p")), "country", "France")
    return out.select("q", "s", "country", F.round("p", 6).alias("p"))


@query(f"""{_ALL}, {_LEGAL} SELECT d.q, d.s, round(CASE WHEN relation = 4 THEN least(greatest(p, sc_nc), 0.01) ELSE greatest(p, sc_nc) END, 6) AS p FROM sides d JOIN lr ON lr.q = d.q AND lr.s = d.s""")
def combine_rounds(spark, folder):
    every = cut(sides(spark, folder).select("q", "s", "p", "sc_nc", P.legal_relation(P.legal_code(F.col("q_nw")), P.legal_code(F.col("s_nw"))).alias("relation")))
    out = D.combine_rounds(every.select("q", "s", "p", "relation"), every.select("q", "s", F.col("sc_nc").alias("p")), cap=F.col("relation") == 4)
    return out.select("q", "s", F.round("p", 6).alias("p"))


def full_parts(r):
    """``r`` with the normalised parts of name and address."""
    named = N.with_name_parts(r, N.fold_latin(F.col("business_name")), F.col("business_name"))
    return N.with_address_parts(named, N.fold_latin(N.number_marks(F.coalesce("business_address", F.lit("")))), F.col("country"))


_LIST = "list_filter(string_split({}, ' '), lambda t: t <> '')"
_NOISE = _quoted([*D.NOISE_FRENCH, *D.NOISE_OTHER])
_SWAP = [w for w in D.NOISE_FRENCH if w not in D.NOISE_NOT_SWAPPED]
_OK = "(len(ex) > 0 AND ((len(mi) = 0 AND len(list_filter(ex, lambda t: t NOT IN ({0}))) = 0 AND len(list_filter(ex, lambda t: t IN ({1}))) > 0) OR (len(mi) = 1 AND len(list_filter(ex, lambda t: t NOT IN ({2}))) = 0 AND len(list_filter(ex, lambda t: t IN ({3}))) > 0)))".format(
    _NOISE, _quoted(D.NOISE_FRENCH), _quoted([*_SWAP, *D.NOISE_OTHER]), _quoted(_SWAP))
_MINUS = "list_filter({0}, lambda t: NOT list_contains({1}, t))"
_SQL_SIM = "len(list_filter(xa, lambda u: length(u) >= 4 AND len(list_filter(xb, lambda v: length(v) >= 4 AND 1.0::DOUBLE - levenshtein(u, v)::DOUBLE / greatest(length(u), length(v)) >= 0.7)) > 0)) > 0"


@query(f"""WITH {_WITH_HEADS}, {_PAIRS}, np AS ({PARTS_SQL['name_parts'].replace(_RECORDS, _WITH_HEADS)}), ap AS ({PARTS_SQL['address_parts'].replace(_RECORDS, _WITH_HEADS)}),
rec AS (SELECT r.entity_id AS id, r.src, r.country, {_LIST.format('n_core')} AS core, {_legal_sql(_LIST.format('n_toks'))} AS legal, {_LIST.format('a_toks')} AS words, coalesce(({_LIST.format('a_nums')})[1], '') AS num
 FROM records r JOIN (SELECT DISTINCT entity_id, n_toks, n_core FROM np) np ON np.entity_id = r.entity_id JOIN (SELECT DISTINCT entity_id, a_toks, a_nums FROM ap) ap ON ap.entity_id = r.entity_id),
generic AS (SELECT t FROM (SELECT id, unnest(list_distinct(words)) AS t FROM rec WHERE src = 1 AND country = 'France') GROUP BY t HAVING count(*) > 1500),
m AS (SELECT p.q, p.s, p.p, {_MINUS.format('a.core', 'b.core')} AS ex, {_MINUS.format('b.core', 'a.core')} AS mi, list_distinct(list_transform(a.words, lambda t: CASE WHEN t = 'b' THEN 'bis' ELSE t END)) AS aw,
 list_distinct(list_transform(b.words, lambda t: CASE WHEN t = 'b' THEN 'bis' ELSE t END)) AS bw, list_filter(a.words, lambda t: list_contains(b.words, t)) AS shared,
 a.country = 'France' AND len(a.words) > 0 AND len(b.words) > 0 AND a.num <> '' AND a.num = b.num AND (a.legal = 0 OR b.legal = 0 OR a.legal = b.legal) AS fits
 FROM pairs p JOIN rec a ON a.id = p.q AND a.src > 1 JOIN rec b ON b.id = p.s AND b.src <= 1),
k AS (SELECT *, list_distinct(ex) AS dx, {_MINUS.format('aw', 'bw')} AS xa, {_MINUS.format('bw', 'aw')} AS xb FROM m),
n AS (SELECT *, coalesce(fits, FALSE) AND {_OK.replace('len(mi)', 'len(list_distinct(mi))')} AND (len(xa) = 0 OR len(xb) = 0 OR (least(len(xa), len(xb)) = 1 AND greatest(len(xa), len(xb)) <= 3 AND {_SQL_SIM}))
 AND ((len(xa) = 0 AND len(xb) = 0) OR len(list_filter(shared, lambda t: NOT list_contains(gl, t))) > 0) AS rule FROM k CROSS JOIN (SELECT coalesce(list(t), []) AS gl FROM generic)),
o AS (SELECT *, rule AND count_if(rule) OVER (PARTITION BY q) = 1 AS noise FROM n)
SELECT q, s, noise, round(CASE WHEN noise THEN greatest(p, 0.97 + 0.02 * p) ELSE p END, 6) AS p FROM o""")
def noise_rule(spark, folder):
    """Pairs of France that differ by noise words only, lifted; over all candidate pairs."""
    parts = cut(full_parts(with_heads(spark, folder).select("src", "entity_id", "country", "business_name", "business_address")).select(
        "src", F.col("entity_id").alias("id"), "country", F.col("n_core").alias("core"), P.legal_code(F.col("n_toks")).alias("legal"), F.col("a_toks").alias("words"), F.coalesce(F.try_element_at("a_nums", F.lit(1)), F.lit("")).alias("number")))
    generic = parts.where("src = 1 and country = 'France'").select("id", F.explode(F.array_distinct("words")).alias("t")).groupBy("t").agg(F.count("*").alias("n")).where("n > 1500")
    side = lambda where, name: parts.where(where).select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("country", "core", "legal", "words", "number")])
    met = cut(pairs(spark, folder).select("q", "s", "p").join(side("src > 1", "q"), "q").join(side("src <= 1", "s"), "s"))
    rule = D.noise_pairs(met, generic).withColumn("noise", F.lit(True))
    out = met.select("q", "s", "p").join(rule, ["q", "s"], "left").withColumn("noise", F.coalesce("noise", F.lit(False)))
    return out.select("q", "s", "noise", F.round(D.noise_floor(F.col("p"), F.col("noise")), 6).alias("p"))


@query(f"WITH {_PAIRS}, e AS (SELECT entity_id AS s, country FROM {_ENTITIES}) SELECT q, p.s, rk FROM pairs p JOIN e ON e.s = p.s WHERE p.p >= 0.5 OR rk < 3 OR (country NOT IN ('US', 'India') AND (rk < 7 OR rk = 99))")
def stage0_prune(spark, folder):
    every = pairs(spark, folder).join(entities(spark, folder).select(F.col("entity_id").alias("s"), "country"), "s")
    return G.prune(every, "p", "rk", F.col("country").isin("US", "India"), least=0.5).select("q", "s", "rk")


@query(f"WITH {_PAIRS} SELECT q, s FROM pairs WHERE p >= 0.0005 AND s IN (SELECT entity_id FROM source1) AND q NOT IN (SELECT entity_id FROM source3 WHERE entity_id IS NOT NULL)")
def semi_anti_filters(spark, folder):
    s1, s3 = table(spark, folder, "source1").select(F.col("entity_id").alias("s")), table(spark, folder, "source3").select(F.col("entity_id").alias("q"))
    return pairs(spark, folder).where("p >= 0.0005").select("q", "s").join(s1, "s", "left_semi").join(s3, "q", "left_anti").select("q", "s")


@query(f"""WITH {_PAIRS}, {_BEST}, l AS (SELECT s, string_agg(q, ',' ORDER BY q) AS ids FROM (SELECT DISTINCT q, s FROM best WHERE p >= 0.5) GROUP BY s)
SELECT DISTINCT entity_id AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM source1 LEFT JOIN l ON l.s = entity_id""")
def match_lists(spark, folder):
    return D.match_lists(table(spark, folder, "source1"), _best(spark, folder).where("p >= 0.5"))


# ------------------------------------------------------------------ learned models


@query()
def word_dictionary(spark, folder):
    """Words in Devanagari with their Latin spelling, learned from the labelled pairs."""
    from weftline.plans.linking import truth_links

    links = truth_links(spark, folder).select(N.fold_latin(F.col("s_name")).alias("a"), F.col("q_name").alias("b"))
    words, variants = learn(cut(links), "a", "b")
    canon = words.join(variants.select(F.col("spelling").alias("canon"), F.col("canon").alias("root")), "canon", "left")
    return canon.select("word", F.coalesce("root", "canon").alias("canon"))


def pair_table(spark, folder):
    """The features of every candidate pair with its label, as numbers."""
    d = sides(spark, folder).withColumns({n: c.cast("double") for n, c in P.number_features(F.col("q_nums"), F.col("s_nums")).items()})
    extra, missing = P.extra_tokens(F.col("q_nw"), F.col("s_nw")), P.extra_tokens(F.col("s_nw"), F.col("q_nw"))
    d = d.withColumns({"n_extra": F.size(extra).cast("double"), "n_missing": F.size(missing).cast("double"), "legal": P.legal_relation(P.legal_code(F.col("q_nw")), P.legal_code(F.col("s_nw"))).cast("double"),
                       "close": D.address_close(F.col("q_ad"), F.col("s_ad")).cast("double"), "sc_ad": F.coalesce("sc_ad", F.lit(-1.0)), "y": F.col("y").cast("double")})
    ranked = C.ranks_and_margins(d, ["sc_nw", "sc_nc", "comb"]).drop("p")
    return ranked.select("q", "s", "country", "data_split", "y", "rk", *[F.col(c).cast("double").alias(c) for c, t in ranked.dtypes if c.startswith(("num_", "sc_", "rank_", "margin_", "n_", "legal", "close", "comb"))])


_FAST = G.Settings(depth=4, rounds=10)


@query()
def gbt_cascade(spark, folder):
    """Two cross-fitted stages over all candidate pairs."""
    d = cut(pair_table(spark, folder))
    features = G.feature_columns(d, ["y", "rk", "n_q*"])
    return G.two_stages(d, features, "y", _FAST).select("q", "s", F.round("p1", 6).alias("p1"), F.round("p", 6).alias("p"))


@query()
def self_training(spark, folder):
    """France is rescored by models that learn from its sure pairs."""
    d = cut(pair_table(spark, folder))
    features = G.feature_columns(d, ["y", "rk", "n_q*"])
    first = cut(G.cross_fit(d, features, "y", settings=_FAST))
    return G.self_train(first, features, "y", "p", F.col("country") == "France", settings=_FAST).select("q", "s", "country", F.round("p", 6).alias("p"))


@query()
def linked_records(spark, folder):
    """The whole chain: candidates, features, two stages, best entity, expected-F decision, one list per entity, chain heads among them."""
    best = Window.partitionBy("q").orderBy(F.col("p").desc(), F.col("s"))
    scored = gbt_cascade(spark, folder).select("q", "s", "p").withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    return D.match_lists(entities(spark, folder), D.expected_f_keep(cut(scored)))


# ------------------------------------------------------------------ samples and importances


@query("SELECT o_orderkey, o_custkey FROM orders WHERE ((o_custkey * 2654435761) >> 7) % 1000 < 300")
def sampled_rows(spark, folder):
    """A sampling operator: all orders of three in ten customers."""
    return sample_rows(table(spark, folder, "orders"), "o_custkey", 0.3).select("o_orderkey", "o_custkey")


@query()
def sampled_queries(spark, folder):
    """A sampling operator: all candidate pairs of 200 queries, as a stage trains on."""
    return sample_keys(pairs(spark, folder).select("q", "s", "comb"), "q", 200)


@query()
def feature_importances(spark, folder):
    """The 30 most used features of a first-stage model."""
    d = cut(pair_table(spark, folder).where("y is not null"))
    features = G.feature_columns(d, ["y", "rk", "n_q*"])
    model = G.fit(d, features, "y", _FAST)
    rows = [(f, float(v)) for f, v in zip(features, model.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(30)


_INDIC_CASES = "".join(f"replace(" for _ in N.INDIC_STATES) + "coalesce(business_address, '')" + "".join(f", '{a}', '{b}')" for a, b in N.INDIC_STATES)


@query(f"WITH {_RECORDS} SELECT entity_id, {_INDIC_CASES} AS address FROM records")
def indic_state_names(spark, folder):
    return records(spark, folder).select("entity_id", N.indic_states(F.col("business_address")).alias("address"))
