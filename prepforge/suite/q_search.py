"""Queries: choice tables, run history, training and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepforge.plans import choices as CH
from prepforge.plans import history as HI
from prepforge.plans.evaluate import comparison, fit_and_score, grid_search, leaderboard, random_search, score_vectors, vectors
from prepforge.plans.pipeline import PrepPipeline
from prepforge.plans.space import SPACE_B, SpacePipeline, random_choices
from prepforge.suite.frames import SQL_C, SQL_H, frame_C, frame_H, frame_Q
from prepforge.suite.helpers import query, rounded, split_frame
from prepforge.session import stored
from prepforge.sources.dataset import encode_label

_C = f"({SQL_C})"


@query("choice_prior", f"""SELECT stage, feature, option, round(p, 6) AS prob, round(ln(p), 6) AS logit FROM (
  SELECT stage, feature, option, CASE WHEN option = 'click' THEN 0.5
    ELSE 0.5 / (count(*) OVER (PARTITION BY stage, feature) - 1) END AS p FROM {_C})""")
def q_choice_prior(spark, sf):
    c = frame_C(spark, sf).select("stage", "feature", "option")
    return rounded(CH.choice_prior(c, "click").select("stage", "feature", "option", "prob", "logit"))


_SOFTMAX = f"""SELECT stage, feature, option, logit, e / sum(e) OVER (PARTITION BY stage, feature) AS prob FROM (
  SELECT *, exp(logit - max(logit) OVER (PARTITION BY stage, feature)) AS e FROM {_C})"""


@query("choice_softmax", f"SELECT stage, feature, option, round(prob, 6) AS prob FROM ({_SOFTMAX})")
def q_choice_softmax(spark, sf):
    return rounded(CH.softmax(frame_C(spark, sf)).select("stage", "feature", "option", "prob"))


@query("choice_argmax", f"""SELECT stage, feature, option, round(logit, 6) AS logit FROM (
  SELECT *, row_number() OVER (PARTITION BY stage, feature ORDER BY logit DESC, option) AS r FROM {_C}) WHERE r = 1""")
def q_choice_argmax(spark, sf):
    return rounded(CH.argmax(frame_C(spark, sf)).select("stage", "feature", "option", "logit"))


@query("choice_gumbel", f"""SELECT stage, feature, option FROM (
  SELECT *, row_number() OVER (PARTITION BY stage, feature ORDER BY
    (logit - ln(-ln((CAST(('0x' || substr(md5(concat_ws(':', '7', CAST(feature AS VARCHAR), option)), 1, 13)) AS BIGINT)
                     + 0.5) / 4503599627370496.0))) / 0.1 DESC, option) AS r FROM {_C}) WHERE r = 1""")
def q_choice_gumbel(spark, sf):
    return CH.gumbel_argmax(frame_C(spark, sf), seed=7).select("stage", "feature", "option")


@query("sinkhorn_order", f"""WITH RECURSIVE c AS (SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY option) - 1 AS j, logit FROM {_C}),
x AS (SELECT f.feature, f.i, f.j, coalesce(c.logit * (f.i + 1), 0) AS v
      FROM (SELECT feature, unnest(range(5)) AS i, j FROM (SELECT feature, unnest(range(5)) AS j FROM (SELECT DISTINCT feature FROM c))) f
      LEFT JOIN c ON c.feature IS NOT DISTINCT FROM f.feature AND c.j = f.j),
m AS (SELECT feature, i, j, exp(v - max(v) OVER (PARTITION BY feature)) AS m, 0 AS t, false AS done FROM x
  UNION ALL
  SELECT feature, i, j, m, t + 1, max(greatest(abs(by_row - 1), abs(by_col - 1))) OVER (PARTITION BY feature) < {CH.SINKHORN_TOL} FROM (
    SELECT *, sum(m) OVER (PARTITION BY feature, i) AS by_row, sum(m) OVER (PARTITION BY feature, j) AS by_col FROM (
      SELECT feature, i, j, t, m / sum(m) OVER (PARTITION BY feature, j) AS m FROM (
        SELECT feature, i, j, t, m / sum(m) OVER (PARTITION BY feature, i) AS m FROM m WHERE NOT done AND t < {CH.SINKHORN_ITERS}))))
SELECT feature, i::INTEGER AS position, j::INTEGER AS stage_idx, round(m, 6) AS prob FROM m QUALIFY t = max(t) OVER (PARTITION BY feature)""")
def q_sinkhorn(spark, sf):
    """Per feature a 5x5 order matrix from its option logits."""
    c = frame_C(spark, sf)
    from pyspark.sql import Window
    w = Window.partitionBy("feature").orderBy("option")
    c = c.withColumn("stage_idx", (F.row_number().over(w) - 1).cast("int"))
    alpha = c.select("feature", "stage_idx", "logit", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("position"))
    alpha = alpha.withColumn("logit", F.col("logit") * (F.col("position") + 1)).withColumn("position", F.col("position").cast("int"))
    return rounded(CH.sinkhorn(alpha))


# ---------------------------------------------------------------- history

@query("history_scalar", f"""SELECT trial, name, epoch, round(value, 6) AS value FROM ({SQL_H})
UNPIVOT (value FOR name IN (val_loss, val_acc))""")
def q_history_scalar(spark, sf):
    return rounded(HI.scalar_log(frame_H(spark, sf), ["val_loss", "val_acc"]))


@query("best_epoch", f"""SELECT trial, epoch AS best_epoch, round(val_loss, 6) AS best_val_loss,
  round(val_acc, 6) AS best_val_acc FROM (
  SELECT *, row_number() OVER (PARTITION BY trial ORDER BY val_loss, epoch) AS r FROM ({SQL_H})) WHERE r = 1""")
def q_best_epoch(spark, sf):
    return rounded(HI.best_epoch(frame_H(spark, sf)))


@query("best_option_history", f"""WITH p0 AS (SELECT stage, feature, option, prob FROM ({_SOFTMAX})),
p AS (SELECT e.epoch, s.stage, feature, option, CASE WHEN (e.epoch + s.stage) % 2 = 0 THEN 1 - prob ELSE prob END AS prob
      FROM p0, (VALUES (0), (1)) e(epoch), (VALUES (1), (2)) s(stage)),
b AS (SELECT epoch, stage, feature, printf('%s:%.2f', option, prob) AS best FROM (
  SELECT *, row_number() OVER (PARTITION BY epoch, stage, feature ORDER BY prob DESC, option) AS r FROM p) WHERE r = 1)
SELECT epoch, feature, string_agg(best, ' | ' ORDER BY stage) AS pipeline FROM b GROUP BY epoch, feature""")
def q_best_option(spark, sf):
    p = CH.softmax(frame_C(spark, sf)).drop("stage").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))
    p = p.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("stage"))
    p = p.withColumn("prob", F.when((F.col("epoch") + F.col("stage")) % 2 == 0, 1 - F.col("prob")).otherwise(F.col("prob")))
    return HI.best_option(p)


@query("top_results", f"""SELECT trial, epoch, round(val_acc, 6) AS val_acc FROM ({SQL_H})
ORDER BY val_acc DESC, trial, epoch LIMIT 10""")
def q_top_results(spark, sf):
    return rounded(HI.top_results(frame_H(spark, sf), 10))


@query("result_summary", f"""SELECT round(avg(val_acc), 6) AS mean_acc, round(median(val_acc), 6) AS median_acc,
  count(*) AS n_results FROM ({SQL_H})""")
def q_result_summary(spark, sf):
    return rounded(HI.result_summary(frame_H(spark, sf)))


@query("early_stop", f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY epoch) AS k FROM ({SQL_H})),
s AS (SELECT DISTINCT trial, 0::BIGINT AS k, 'inf'::DOUBLE AS bl, NULL::DOUBLE AS ba, NULL::INTEGER AS be, '-inf'::DOUBLE AS last,
             {HI.PATIENCE} AS pat, NULL::INTEGER AS stop FROM h
  UNION ALL
  SELECT trial, k, bl, ba, be, CASE WHEN small THEN last ELSE ba END, CASE WHEN small THEN pat - 1 ELSE {HI.PATIENCE} END,
         CASE WHEN small AND pat <= 1 THEN epoch END FROM (
    SELECT *, ba - last < {HI.MIN_GAIN} AS small FROM (
      SELECT h.trial, h.k, h.epoch, s.last, s.pat, least(h.val_loss, s.bl) AS bl, CASE WHEN h.val_loss < s.bl THEN h.val_acc ELSE s.ba END AS ba,
             CASE WHEN h.val_loss < s.bl THEN h.epoch ELSE s.be END AS be
      FROM s JOIN h ON h.trial = s.trial AND h.k = s.k + 1 WHERE s.stop IS NULL)))
SELECT trial, stop AS stop_epoch, be AS best_epoch, round(ba, 6) AS best_val_acc FROM s QUALIFY k = max(k) OVER (PARTITION BY trial)""")
def q_early_stop(spark, sf):
    """The stopping rule replayed per trial."""
    return rounded(HI.early_stop(frame_H(spark, sf)))


# ---------------------------------------------------------------- training / search (document quality)

Q_FEATS = ["n_chars", "lang", "source"]


def _Q(spark, sf):
    q = encode_label(frame_Q(spark, sf), "quality", out="label")
    return split_frame(q, "doc_id")


def _prep_default(df):
    pipe = PrepPipeline({"imputation": "mean", "scaling": "standard", "encoding": "onehot"})
    model = pipe.fit(df, Q_FEATS, label="label", split_col="split")
    return model.transform(df), model.output_cols


@query("train_eval_logreg")
def q_train_eval(spark, sf):
    df = _Q(spark, sf)
    out, feats = _prep_default(df)
    _, res = fit_and_score(out, feats, "label")
    row = res.as_row(method="default", dataset="documents_quality")
    row.pop("seconds")
    return spark.createDataFrame([row])


@query("grid_search")
def q_grid(spark, sf):
    df = _Q(spark, sf)
    out, feats = _prep_default(df)
    data = vectors(out, feats, "label")
    trials = grid_search(spark, lambda p: score_vectors(data, **p)[1],
                         {"reg": [0.0, 0.01, 0.1], "max_iter": [50, 100]})
    return trials.drop("seconds")


@query("random_search")
def q_random(spark, sf):
    """EVL7: seeded pipelines of search space B, each with every grid point;
    the rows are joined and split once for all."""
    df = stored(_Q(spark, sf), "rows")

    def prepare(seed):
        m = SpacePipeline(SPACE_B, random_choices(SPACE_B, ["n_chars"], ["lang", "source"], seed=seed)).fit(df, Q_FEATS, "label", "split", key="doc_id")
        return vectors(m.transform(df, with_weight=True), m.features, "label", weight="_row_weight")

    return random_search(spark, prepare, grid={"reg": [0.0, 0.01]}).drop("seconds")


@query("leaderboard")
def q_leaderboard(spark, sf):
    df = _Q(spark, sf)
    out, feats = _prep_default(df)
    return leaderboard(out, feats, "label", n_classes=2).drop("fit_seconds")


@query("comparison")
def q_comparison(spark, sf):
    df = _Q(spark, sf)
    out, feats = _prep_default(df)
    _, base = fit_and_score(out, feats, "label")
    lb = leaderboard(out, feats, "label", n_classes=2).collect()[0]
    rec = comparison(base.as_row(), {"accuracy": lb["accuracy"]}, "documents_quality", f"default+{lb['model']}")
    return spark.createDataFrame([rec])


# ---------------------------------------------------------------- gradient search (EVL8)

def _search(spark, sf, flexible: bool):
    """The library's 30 iterations over search space A."""
    from prepforge.plans.gradient import gradient_search
    from prepforge.plans.space import SPACE_A
    df = _Q(spark, sf)
    return df, gradient_search(df, Q_FEATS, "label", SPACE_A, key="doc_id", flexible=flexible)


def _search_log(spark, state):
    """Option probabilities after each update, with that iteration's scores."""
    probs = HI.option_log(spark, state.probs_log)
    hist = spark.createDataFrame([(h["iteration"], *[float(h[c]) for c in ("tr_loss", "val_loss", "val_acc")]) for h in state.history],
                                 "epoch int, tr_loss double, val_loss double, val_acc double")
    return probs.join(hist, "epoch")


@query("search_fixed")
def q_search_fixed(spark, sf):
    """Fixed stage order: the log of the option probabilities and losses."""
    return rounded(_search_log(spark, _search(spark, sf, flexible=False)[1]))


@query("search_flex")
def q_search_flex(spark, sf):
    """Flexible order (Sinkhorn-normalised position x stage weights): the stage
    that each feature takes at each position, with the weight of the best iteration."""
    from prepforge.plans.gradient import sinkhorn_np, stage_order
    from prepforge.plans.space import SPACE_A
    _, state = _search(spark, sf, flexible=True)
    names = [st.name for st in SPACE_A[1:]]
    rows = [(f, pos, st, float(sinkhorn_np(state.alpha[f])[0][pos, names.index(st)])) for f, o in stage_order(state, SPACE_A).items() for pos, st in enumerate(o)]
    return rounded(spark.createDataFrame(rows, "feature string, position int, stage string, prob double"))


@query("final_dataset")
def q_final_dataset(spark, sf):
    """PIP18: the arg-max options of a flexible search in its learned order,
    frozen and applied to every split (val/test rows are never removed)."""
    from prepforge.plans.gradient import final_dataset
    from prepforge.plans.space import SPACE_A
    df, state = _search(spark, sf, flexible=True)
    model, out = final_dataset(df, Q_FEATS, "label", SPACE_A, state, key="doc_id")
    return rounded(out.select("doc_id", "split", "label", *model.features))


@query("search_result")
def q_search_result(spark, sf):
    """EVL9: default pipeline, the search's best iteration, and the classifier
    retrained on the final dataset."""
    from prepforge.plans.gradient import retrain, search_result
    from prepforge.plans.space import SPACE_A, default_choices
    df, state = _search(spark, sf, flexible=False)
    m = SpacePipeline(SPACE_A, default_choices(SPACE_A, ["n_chars"], ["lang", "source"])).fit(df, Q_FEATS, "label", "split", key="doc_id")
    _, base = fit_and_score(m.transform(df, with_weight=True), m.features, "label", weight="_row_weight")
    _, final = retrain(df, Q_FEATS, "label", SPACE_A, state, "doc_id")
    records = [r.as_row(method=n, dataset="documents_quality") for n, r in (("default", base), ("search", search_result(state)), ("retrained", final))]
    return rounded(spark.createDataFrame(records).drop("seconds"))
