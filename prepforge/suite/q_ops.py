"""Queries: closed-form preparation operators (fit on train, apply to all)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepforge.operators.discretize import Discretize
from prepforge.operators.encoding import Encode, OneHotFitted
from prepforge.operators.imputation import Impute
from prepforge.operators.outliers import RemoveOutliers, RepairOutliers
from prepforge.operators.scaling import Scale, prenormalize
from prepforge.operators.selection import SelectFeatures
from prepforge.suite.frames import SQL_B, SQL_E, SQL_O, SQL_P, frame_B, frame_E, frame_O, frame_P, sql_split, table
from prepforge.suite.helpers import fit_apply, long_form, query, rounded, split_frame, train_of

E_SPLIT = sql_split(SQL_E, "event_id")
P_SPLIT = sql_split(SQL_P, "p_partkey")
O_SPLIT = sql_split(SQL_O, "o_orderkey")


def _E(spark, sf):
    return split_frame(frame_E(spark, sf), "event_id")


def _P(spark, sf):
    return split_frame(frame_P(spark, sf), "p_partkey")


def _O(spark, sf):
    return split_frame(frame_O(spark, sf), "o_orderkey")


E_COLS = ["value_m", "user_m", "type_m"]
P_NUM = ["size", "price", "price_m", "const"]


def _imp_sql(num_fill: str, cat_fill: str) -> str:
    """num_fill/cat_fill are SQL templates over column {c}, evaluated on train."""
    nv = num_fill.format(c="value_m")
    nu = num_fill.format(c="user_m")
    ct = cat_fill.format(c="type_m")
    return f"""WITH s AS ({E_SPLIT}), t AS (SELECT * FROM s WHERE split = 'train')
SELECT event_id, split, round(coalesce(value_m, {nv}), 6) AS value_m, round(coalesce(user_m, {nu}), 6) AS user_m,
  coalesce(type_m, {ct}) AS type_m FROM s"""


_MODE = "(SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _imp(method):
    def run(spark, sf):
        df = fit_apply(_E(spark, sf), Impute(method), E_COLS)
        return rounded(df.select("event_id", "split", *E_COLS))
    return run


query("impute_mean", _imp_sql("(SELECT avg({c}) FROM t)", _MODE))(_imp("mean"))
query("impute_median", _imp_sql("(SELECT quantile_cont({c}, 0.5) FROM t)", _MODE))(_imp("median"))
query("impute_mode_num", _imp_sql(_MODE, _MODE))(_imp("most_frequent"))
query("impute_constant", _imp_sql("0.0", "'0'"))(_imp("constant"))
query("impute_dummy", _imp_sql("NULL", "'dummy_category'"))(_imp("dummy"))


@query("impute_mode_cat", f"""WITH s AS ({E_SPLIT}), t AS (SELECT * FROM s WHERE split = 'train')
SELECT event_id, split, coalesce(type_m, {_MODE.format(c="type_m")}) AS type_m FROM s""")
def q_mode_cat(spark, sf):
    df = fit_apply(_E(spark, sf), Impute("most_frequent"), ["type_m"])
    return df.select("event_id", "split", "type_m")


@query("impute_preprocessor_policy", f"""WITH s AS ({E_SPLIT}), t AS (SELECT * FROM s WHERE split = 'train')
SELECT event_id, split, round(coalesce(value_m, (SELECT quantile_cont(value_m, 0.5) FROM t)), 6) AS value_m,
  type_m FROM s""")
def q_imp_policy(spark, sf):
    """IMP14: the single-class preprocessor leaves categoricals missing unless
    the method is most_frequent/constant."""
    df = fit_apply(_E(spark, sf), Impute("median", cat_policy="same"), ["value_m", "type_m"])
    return rounded(df.select("event_id", "split", "value_m", "type_m"))


# ---------------------------------------------------------------- scaling

def _scale_sql(shift: str, scale: str, clip01: bool = False) -> str:
    cols = []
    for c in P_NUM:
        e = f"({c} - {shift.format(c=c)}) / {scale.format(c=c)}"
        if clip01:
            e = f"CASE WHEN {c} IS NULL THEN NULL ELSE greatest(least({e}, 1.0), 0.0) END"
        e = f"CASE WHEN {c} IS NULL THEN NULL ELSE greatest(least({e}, 1e10), -1e10) END"
        cols.append(f"round({e}, 6) AS {c}")
    return f"""WITH s AS ({P_SPLIT}), t AS (SELECT * FROM s WHERE split = 'train')
SELECT p_partkey, split, {", ".join(cols)} FROM s"""


def _nz(e: str) -> str:
    return f"(SELECT CASE WHEN v IS NULL OR v = 0 THEN 1.0 ELSE v END FROM (SELECT {e} AS v FROM t))"


def _scale(method):
    def run(spark, sf):
        df = fit_apply(_P(spark, sf), Scale(method), P_NUM)
        return rounded(df.select("p_partkey", "split", *P_NUM))
    return run


query("scale_standard", _scale_sql("(SELECT avg({c}) FROM t)", _nz("stddev_pop({c})")))(_scale("standard"))
query("scale_minmax", _scale_sql("(SELECT min({c}) FROM t)", _nz("max({c}) - min({c})")))(_scale("minmax"))
query("scale_minmax_clip", _scale_sql("(SELECT min({c}) FROM t)", _nz("max({c}) - min({c})"), True))(_scale("minmax_clip"))
query("scale_robust", _scale_sql("(SELECT quantile_cont({c}, 0.5) FROM t)",
                                 _nz("quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")))(_scale("robust"))
query("scale_maxabs", _scale_sql("0.0", _nz("max(abs({c}))")))(_scale("maxabs"))


@query("prenorm_split", f"""WITH s AS ({O_SPLIT}), t AS (SELECT * FROM s WHERE split = 'train')
SELECT o_orderkey, split,
  round((o_totalprice - (SELECT min(o_totalprice) FROM t)) / {_nz("max(o_totalprice) - min(o_totalprice)")}, 6) AS o_totalprice,
  round((cust - (SELECT min(cust) FROM t)) / {_nz("max(cust) - min(cust)")}, 6) AS cust,
  prio_m FROM s""")
def q_prenorm(spark, sf):
    df, _ = prenormalize(_O(spark, sf), ["o_totalprice", "cust", "prio_m"])
    return rounded(df.select("o_orderkey", "split", "o_totalprice", "cust", "prio_m"))


# ---------------------------------------------------------------- encoding

def _onehot_sql(src: str, key: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT s.{key}, s.split, '{c}_' || coalesce(v.val, 'nan') AS column_name,
  CASE WHEN s.{c} IS NOT DISTINCT FROM v.val THEN 1.0 ELSE 0.0 END AS value
FROM s, (SELECT DISTINCT {c} AS val FROM s WHERE split = 'train') v""")
    return f"WITH s AS ({src})\n" + "\nUNION ALL\n".join(parts)


@query("encode_onehot", _onehot_sql(P_SPLIT, "p_partkey", ["p_brand", "p_type"]))
def q_onehot(spark, sf):
    df = _P(spark, sf)
    fitted = Encode("onehot").fit(train_of(df), ["p_brand", "p_type"])
    out = fitted.transform(df)
    new = [c for c in fitted.out_cols([]) if c]
    return long_form(out, ["p_partkey", "split"], new)


@query("encode_onehot_union", f"""WITH s0 AS ({E_SPLIT}), t AS (SELECT * FROM s0 WHERE split = 'train'),
s AS (SELECT event_id, split, coalesce(type_m, {_MODE.format(c="type_m")}) AS t_mode,
             coalesce(type_m, 'dummy_category') AS t_dummy FROM s0),
v AS (SELECT DISTINCT val FROM (SELECT t_mode AS val FROM s WHERE split = 'train'
                                UNION ALL SELECT t_dummy FROM s WHERE split = 'train'))
SELECT s.event_id, s.split, 'mode' AS variant, 'type_m_' || v.val AS column_name,
  CASE WHEN s.t_mode = v.val THEN 1.0 ELSE 0.0 END AS value FROM s, v
UNION ALL
SELECT s.event_id, s.split, 'dummy', 'type_m_' || v.val, CASE WHEN s.t_dummy = v.val THEN 1.0 ELSE 0.0 END FROM s, v""")
def q_onehot_union(spark, sf):
    """ENC2: every imputed alternative of a column is one-hot encoded with one
    shared vocabulary (fitted on the union of the alternatives)."""
    from prepforge.operators.encoding import union_vocab
    df = _E(spark, sf)
    mode_fill = Impute("most_frequent").fit(train_of(df), ["type_m"]).params["fill"]["type_m"]
    alt = df.select("event_id", "split", F.coalesce("type_m", F.lit(mode_fill)).alias("t_mode"),
                    F.coalesce("type_m", F.lit("dummy_category")).alias("t_dummy"))
    vocab = union_vocab(train_of(alt), {"type_m": ["t_mode", "t_dummy"]})["type_m"]
    outs = []
    for variant, col in (("mode", "t_mode"), ("dummy", "t_dummy")):
        fitted = OneHotFitted("encode.onehot", [col], {"vocab": {col: vocab}})
        wide = fitted.transform(alt.select("event_id", "split", col))
        names = fitted.out_cols([])
        lf = long_form(wide, ["event_id", "split"], names)
        lf = lf.withColumn("column_name", F.regexp_replace("column_name", f"^{col}_", "type_m_"))
        outs.append(lf.withColumn("variant", F.lit(variant)))
    return outs[0].unionByName(outs[1])


_FREQ_SQL = f"""WITH s AS ({E_SPLIT}), t AS (SELECT * FROM s WHERE split = 'train'),
c AS (SELECT type_m, count(*) {{div}} AS v FROM t GROUP BY type_m)
SELECT s.event_id, s.split, round(coalesce(c.v, 0.0), 6) AS type_m FROM s LEFT JOIN c ON s.type_m IS NOT DISTINCT FROM c.type_m"""


@query("encode_frequency", _FREQ_SQL.format(div="/ (SELECT count(*) FROM t)"))
def q_freq(spark, sf):
    df = fit_apply(_E(spark, sf), Encode("frequency"), ["type_m"])
    return rounded(df.select("event_id", "split", "type_m"))


@query("encode_count", _FREQ_SQL.format(div="* 1.0"))
def q_count(spark, sf):
    df = fit_apply(_E(spark, sf), Encode("count"), ["type_m"])
    return rounded(df.select("event_id", "split", "type_m"))


_ORD_CTE = f"""WITH s AS ({E_SPLIT}), t AS (SELECT * FROM s WHERE split = 'train'),
o AS (SELECT type_m, row_number() OVER (ORDER BY min(event_id), type_m) AS code
      FROM t WHERE type_m IS NOT NULL GROUP BY type_m),
e AS (SELECT s.event_id, s.split, CASE WHEN s.type_m IS NULL THEN -2 ELSE coalesce(o.code, -1) END AS code
      FROM s LEFT JOIN o ON s.type_m = o.type_m)"""


@query("encode_ordinal", _ORD_CTE + "\nSELECT event_id, split, CAST(code AS DOUBLE) AS type_m FROM e")
def q_ordinal(spark, sf):
    df = fit_apply(_E(spark, sf), Encode("ordinal", key="event_id"), ["type_m"])
    return df.select("event_id", "split", "type_m")


@query("encode_binary", _ORD_CTE + """,
nb AS (SELECT CAST(floor(log2(count(*))) + 1 AS INTEGER) AS nb FROM o)
SELECT e.event_id, e.split, 'type_m_' || CAST(b.j AS VARCHAR) AS column_name,
  CASE WHEN e.code > 0 THEN CAST((e.code >> (nb.nb - 1 - b.j)) & 1 AS DOUBLE) ELSE 0.0 END AS value
FROM e, nb, range(0, (SELECT nb FROM nb)) b(j)""")
def q_binary(spark, sf):
    df = _E(spark, sf)
    fitted = Encode("binary", key="event_id").fit(train_of(df), ["type_m"])
    out = fitted.transform(df.select("event_id", "split", "type_m"))
    return long_form(out, ["event_id", "split"], fitted.out_cols([]))


# ---------------------------------------------------------------- outliers

O_NUM = ["o_totalprice", "cust"]


L_SPLIT = sql_split("SELECT l_orderkey * 10 + l_linenumber AS line, l_extendedprice AS price, l_extendedprice * l_discount * l_discount AS cut FROM lineitem", "line")


@query("remove_iqr", f"""WITH s AS ({L_SPLIT}), t AS (SELECT * FROM s WHERE split = 'train'),
q AS (SELECT quantile_cont(price, 0.25) AS a1, quantile_cont(price, 0.75) AS b1, quantile_cont(cut, 0.25) AS a2, quantile_cont(cut, 0.75) AS b2 FROM t)
SELECT line, split FROM s, q WHERE split <> 'train' OR (
  (b1 - a1 <= 0 OR coalesce(price BETWEEN a1 - 1.5 * (b1 - a1) AND b1 + 1.5 * (b1 - a1), false)) AND
  (b2 - a2 <= 0 OR coalesce(cut BETWEEN a2 - 1.5 * (b2 - a2) AND b2 + 1.5 * (b2 - a2), false)))""")
def q_remove_iqr(spark, sf):
    x = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_extendedprice").alias("price"),
                                            (F.col("l_extendedprice") * F.col("l_discount") * F.col("l_discount")).alias("cut"))
    df = fit_apply(split_frame(x, "line"), RemoveOutliers("iqr", split_col="split"), ["price", "cut"])
    return df.select("line", "split")


@query("remove_zscore", f"""WITH s AS ({E_SPLIT}), t AS (SELECT * FROM s WHERE split = 'train'),
q AS (SELECT avg(value_m) AS m1, stddev_pop(value_m) AS s1, avg(user_m) AS m2, stddev_pop(user_m) AS s2 FROM t)
SELECT event_id, split FROM s, q
WHERE split <> 'train' OR (
  (s1 = 0 OR coalesce(abs((value_m - m1) / s1) < 3, true)) AND (s2 = 0 OR coalesce(abs((user_m - m2) / s2) < 3, true)))""")
def q_remove_z(spark, sf):
    df = fit_apply(_E(spark, sf), RemoveOutliers("zscore", split_col="split"), ["value_m", "user_m"])
    return df.select("event_id", "split")


def _repair_sql(bounds_cte: str) -> str:
    out = []
    for c in ("value_m", "user_m"):
        out.append(f"""round(CASE WHEN {c} IS NULL OR {c} > hi_{c} OR {c} < lo_{c} THEN f_{c} ELSE {c} END, 6) AS {c}""")
    fills = ", ".join(f"(SELECT avg({c}) FROM t, b WHERE {c} BETWEEN lo_{c} AND hi_{c}) AS f_{c}" for c in ("value_m", "user_m"))
    return f"""WITH s AS ({E_SPLIT}), t AS (SELECT * FROM s WHERE split = 'train'), b AS ({bounds_cte}),
f AS (SELECT {fills})
SELECT event_id, split, {", ".join(out)} FROM s, b, f"""


def _zs_bounds(k):
    return "SELECT " + ", ".join(
        f"avg({c}) - {k} * stddev_pop({c}) AS lo_{c}, avg({c}) + {k} * stddev_pop({c}) AS hi_{c}" for c in ("value_m", "user_m")) + " FROM t"


def _iqr_bounds(k):
    return "SELECT " + ", ".join(
        f"quantile_cont({c}, 0.25) - {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
        f"quantile_cont({c}, 0.75) + {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
        for c in ("value_m", "user_m")) + " FROM t"


def _mad_bounds(k):
    med = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in ("value_m", "user_m"))
    return (f"SELECT " + ", ".join(
        f"m_{c} - {k} * (SELECT quantile_cont(abs({c} - m_{c}), 0.5) FROM t) AS lo_{c}, "
        f"m_{c} + {k} * (SELECT quantile_cont(abs({c} - m_{c}), 0.5) FROM t) AS hi_{c}" for c in ("value_m", "user_m"))
        + f" FROM (SELECT {med} FROM t)")


def _repair(name):
    def run(spark, sf):
        df = fit_apply(_E(spark, sf), RepairOutliers(name), ["value_m", "user_m"])
        return rounded(df.select("event_id", "split", "value_m", "user_m"))
    return run


query("repair_zs", _repair_sql(_zs_bounds(2)))(_repair("ZS_2"))
query("repair_iqr", _repair_sql(_iqr_bounds(1.5)))(_repair("IQR_1.5"))
query("repair_mad", _repair_sql(_mad_bounds(2.5)))(_repair("MAD_2.5"))


@query("detect_mask", f"""WITH s AS ({E_SPLIT}), t AS (SELECT * FROM s WHERE split = 'train'), b AS ({_iqr_bounds(1)})
SELECT event_id, split, coalesce(value_m > hi_value_m OR value_m < lo_value_m, false) AS value_m_out,
  coalesce(user_m > hi_user_m OR user_m < lo_user_m, false) AS user_m_out FROM s, b""")
def q_mask(spark, sf):
    df = _E(spark, sf)
    fitted = RepairOutliers("IQR_1").fit(train_of(df), ["value_m", "user_m"])
    return df.select("event_id", "split",
                     F.coalesce(fitted.mask("value_m"), F.lit(False)).alias("value_m_out"),
                     F.coalesce(fitted.mask("user_m"), F.lit(False)).alias("user_m_out"))


# ---------------------------------------------------------------- binning

@query("bin_uniform", f"""WITH s AS ({E_SPLIT}), t AS (SELECT * FROM s WHERE split = 'train'),
b AS (SELECT min(value_m) AS a1, (max(value_m) - min(value_m)) / 10 AS w1,
             min(user_m) AS a2, (max(user_m) - min(user_m)) / 10 AS w2 FROM t)
SELECT event_id, split,
  CASE WHEN value_m IS NULL THEN NULL ELSE
    CAST(greatest(0, least(9, trunc(greatest(least((value_m - a1) / (w1 + 1e-12), 10.0), -1.0)))) AS DOUBLE) END AS value_m,
  CASE WHEN user_m IS NULL THEN NULL ELSE
    CAST(greatest(0, least(9, trunc(greatest(least((user_m - a2) / (w2 + 1e-12), 10.0), -1.0)))) AS DOUBLE) END AS user_m
FROM s, b""")
def q_bin_uniform(spark, sf):
    df = fit_apply(_E(spark, sf), Discretize("uniform_10"), ["value_m", "user_m"])
    return df.select("event_id", "split", "value_m", "user_m")


def _qbin_sql(src: str, key: str, cols: list[str], n_bins: int) -> str:
    ctes, sel = [], []
    for c in cols:
        ctes.append(f"""r_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS rn, count(*) OVER () AS nn
  FROM t WHERE {c} IS NOT NULL),
st_{c} AS (SELECT CAST(round_even(max(nn) / {n_bins}.0, 0) AS BIGINT) AS step FROM r_{c}),
cut_{c} AS (SELECT v FROM r_{c}, st_{c} WHERE step > 0 AND rn < nn - 1 AND (rn + 1) % step = 0)""")
        sel.append(f"""CASE WHEN s.{c} IS NULL THEN NULL ELSE CAST(least({n_bins - 1},
  (SELECT count(*) FROM cut_{c} WHERE s.{c} > cut_{c}.v)) AS DOUBLE) END AS {c}""")
    return (f"WITH s AS ({src}), t AS (SELECT * FROM s WHERE split = 'train'),\n" + ",\n".join(ctes)
            + f"\nSELECT s.{key}, s.split, " + ", ".join(sel) + " FROM s")


@query("bin_quantile", _qbin_sql(O_SPLIT, "o_orderkey", O_NUM, 20))
def q_bin_quantile(spark, sf):
    df = fit_apply(_O(spark, sf), Discretize("quantile_20"), O_NUM)
    return df.select("o_orderkey", "split", *O_NUM)


# ---------------------------------------------------------------- selection

_B_DIMS = [f"d{i}" for i in range(64)]
_B_LONG = f"""SELECT vec_id, label, column_name, x FROM ({SQL_B}) UNPIVOT (x FOR column_name IN ({", ".join(_B_DIMS)}))"""


@query("select_variance", f"""SELECT column_name, round(var_pop(x), 6) AS score, var_pop(x) > 0.01 AS selected
FROM ({_B_LONG}) GROUP BY column_name""")
def q_sel_var(spark, sf):
    b = frame_B(spark, sf)
    fitted = SelectFeatures("variance_threshold").fit(b, _B_DIMS)
    keep = set(fitted.params["keep"])
    rows = [(c, fitted.params["scores"][c], c in keep) for c in _B_DIMS]
    return rounded(spark.createDataFrame(rows, "column_name string, score double, selected boolean"))


_RANK_SEL = """SELECT column_name, round(score, 6) AS score,
  row_number() OVER (ORDER BY coalesce(score, -1e308) DESC, CAST(substr(column_name, 2) AS INTEGER) DESC) <= 10 AS selected
FROM sc"""


@query("select_anova", f"""WITH l AS ({_B_LONG}),
g AS (SELECT column_name, label, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY column_name, label),
a AS (SELECT column_name, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS gm FROM g GROUP BY column_name),
sc AS (SELECT g.column_name, (sum(g.n * (g.m - a.gm) * (g.m - a.gm)) / (max(a.k) - 1))
           / (sum(g.n * g.v) / (max(a.n) - max(a.k))) AS score
       FROM g JOIN a ON g.column_name = a.column_name GROUP BY g.column_name)
{_RANK_SEL}""")
def q_sel_anova(spark, sf):
    b = frame_B(spark, sf)
    fitted = SelectFeatures("k_best", k=10).fit(b, _B_DIMS, "label")
    keep = set(fitted.params["keep"])
    rows = [(c, float(fitted.params["scores"][c]), c in keep) for c in _B_DIMS]
    return rounded(spark.createDataFrame(rows, "column_name string, score double, selected boolean"))


@query("select_mi_binned", f"""WITH l AS ({_B_LONG}),
r AS (SELECT column_name, label, x, row_number() OVER (PARTITION BY column_name ORDER BY x) - 1 AS rn,
             count(*) OVER (PARTITION BY column_name) AS nn FROM l WHERE x IS NOT NULL),
st AS (SELECT column_name, max(nn) AS nn, CAST(round_even(max(nn) / 20.0, 0) AS BIGINT) AS step FROM r GROUP BY column_name),
cut AS (SELECT r.column_name, r.x AS v FROM r JOIN st ON r.column_name = st.column_name
        WHERE st.step > 0 AND r.rn < st.nn - 1 AND (r.rn + 1) % st.step = 0),
bn AS (SELECT r.column_name, r.label, least(19, (SELECT count(*) FROM cut WHERE cut.column_name = r.column_name AND r.x > cut.v)) AS b
       FROM r),
c AS (SELECT column_name, b, label, count(*) AS n FROM bn GROUP BY column_name, b, label),
tot AS (SELECT column_name, sum(n) AS t FROM c GROUP BY column_name),
pb AS (SELECT column_name, b, sum(n) AS nb FROM c GROUP BY column_name, b),
py AS (SELECT column_name, label, sum(n) AS ny FROM c GROUP BY column_name, label),
sc AS (SELECT c.column_name, sum(c.n / tot.t * ln(c.n * tot.t / (pb.nb * py.ny))) AS score
       FROM c JOIN tot ON c.column_name = tot.column_name
       JOIN pb ON c.column_name = pb.column_name AND c.b = pb.b
       JOIN py ON c.column_name = py.column_name AND c.label = py.label GROUP BY c.column_name)
{_RANK_SEL}""")
def q_sel_mi(spark, sf):
    b = frame_B(spark, sf)
    fitted = SelectFeatures("mutual_info", k=10).fit(b, _B_DIMS, "label")
    keep = set(fitted.params["keep"])
    rows = [(c, float(fitted.params["scores"][c]), c in keep) for c in _B_DIMS]
    return rounded(spark.createDataFrame(rows, "column_name string, score double, selected boolean"))


@query("select_mi_knn")
def q_sel_mi_knn(spark, sf):
    """Nearest-neighbour estimate over all dimensions."""
    fitted = SelectFeatures("mutual_info_knn", k=10, key="vec_id").fit(frame_B(spark, sf), _B_DIMS, "label")
    keep = set(fitted.params["keep"])
    rows = [(c, float(fitted.params["scores"][c]), c in keep) for c in _B_DIMS]
    return rounded(spark.createDataFrame(rows, "column_name string, score double, selected boolean"))


_USER = "CASE WHEN event_id % 11 <> 0 THEN 'u' || user_id END"


@query("encode_onehot_sparse", f"""WITH s AS ({sql_split(f"SELECT event_id, {_USER} AS who FROM events", "event_id")}),
v AS (SELECT who, row_number() OVER (ORDER BY who NULLS LAST) - 1 AS slot FROM (SELECT DISTINCT who FROM s WHERE split = 'train'))
SELECT s.event_id, s.split, coalesce(v.slot, -1)::INTEGER AS slot, (SELECT count(*) FROM v)::INTEGER AS width
FROM s LEFT JOIN v ON s.who IS NOT DISTINCT FROM v.who""")
def q_onehot_sparse(spark, sf):
    """The slot that is 1 in each row's vector (-1: none)."""
    e = table(spark, sf, "events").select("event_id", F.expr("CASE WHEN event_id % 11 <> 0 THEN concat('u', user_id) END").alias("who"))
    out = fit_apply(split_frame(e, "event_id"), Encode("onehot_sparse"), ["who"])
    # the vectors stay sparse: a row costs its own entries, not a slot per category
    out = out.withColumn("who", F.unwrap_udt("who"))
    return out.select("event_id", "split", F.coalesce(F.get("who.indices", F.lit(0)), F.lit(-1)).alias("slot"), F.col("who.size").alias("width"))


# ---------------------------------------------------------------- a category called like the missing one

_NAN = "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'nan' ELSE event_type END"


@query("encode_onehot_nan_literal", f"""WITH s AS ({sql_split(f"SELECT event_id, {_NAN} AS kind FROM events", "event_id")}),
v AS (SELECT DISTINCT kind AS val, CASE WHEN kind IS NULL THEN 'kind_nan__1' ELSE 'kind_' || kind END AS name FROM s WHERE split = 'train')
SELECT s.event_id, s.split, v.name AS column_name, CASE WHEN s.kind IS NOT DISTINCT FROM v.val THEN 1.0 ELSE 0.0 END AS value FROM s, v""")
def q_onehot_nan(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, "nan").otherwise(F.col("event_type"))
    df = split_frame(e.select("event_id", kind.alias("kind")), "event_id")
    fitted = Encode("onehot").fit(train_of(df), ["kind"])
    return long_form(fitted.transform(df), ["event_id", "split"], fitted.out_cols(["kind"]))
