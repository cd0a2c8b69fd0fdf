"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables through the adapters, so its work grows
with them. Column names equal the ones of the SQL oracle (``oracle.py``).
"""

from __future__ import annotations

import datetime as _dt
import functools

from pyspark.sql import functions as F

from churnlake import schema as S
from churnlake.operators import clean, encode, evaluate, explain, explore, features, roster, sample
from churnlake.operators import select as sel
from churnlake.operators import text
from churnlake.plans import pipeline
from churnlake.sources import adapters, io

SCORER = explain.DEMO_SCORER


def _subs(spark, sf, text_=False):
    return adapters.subscribers(spark, sf, with_text=text_)


def _prepared(spark, sf):
    return pipeline.subscribers_prepared(spark, sf, with_text=True)


def _structured(spark, sf):
    return pipeline.subscribers_structured(spark, sf)


def _scored(spark, sf):
    return adapters.scored(spark, sf)


def _models(spark, sf):
    return adapters.scored_models(spark, sf)


def _split(spark, sf):
    return sample.stratified_split(_prepared(spark, sf))


# ------------------------------------------------------------------ sources / sinks

def q_load_customers(spark, sf):
    path = io.save_versioned(_subs(spark, sf, True), prefix="customers_csv", ts=_dt.datetime.now())
    return io.load_customers(spark, path)


def q_load_checked(spark, sf):
    path = io.save_versioned(_subs(spark, sf), prefix="customers_upload", ts=_dt.datetime.now())
    return io.load_checked(spark, path)


def q_missing_columns(spark, sf):
    return io.missing_columns(_subs(spark, sf), io.REQUIRED_DEFAULT + ["network_quality"])


def q_save_versioned(spark, sf):
    df = _structured(spark, sf)
    path = io.save_versioned(df, prefix="processed", ts=_dt.datetime.now())
    return io.load_customers(spark, path, schema=df.schema)


def q_save_roster(spark, sf):
    df = _structured(spark, sf)
    r = roster.high_risk_roster(df.withColumn("p", SCORER.probability()), top_n=20)
    path = io.save_roster(r, ts=_dt.datetime.now())
    return io.load_customers(spark, path, schema=r.schema)


def q_save_model_comparison(spark, sf):
    comp = evaluate.model_comparison(_models(spark, sf))
    path = io.save_model_comparison(comp, ts=_dt.datetime.now())
    return io.load_customers(spark, path, schema=comp.schema)


# ------------------------------------------------------------------ cleaning / quality

def q_clean_total_charges(spark, sf):
    return clean.clean_total_charges(_subs(spark, sf)).select(S.ID_COLUMN, "TotalCharges")


def q_imputed_count(spark, sf):
    return clean.imputed_count(_subs(spark, sf))


def q_dedup_customers(spark, sf):
    d = clean.dedup_first(adapters.dup_customers(spark, sf), ["ts", "event_id"])
    return d.select(S.ID_COLUMN, "event_id", "event_type", "value")


def q_quality_shape(spark, sf):
    return clean.quality_shape(_subs(spark, sf, True))


def q_quality_missing(spark, sf):
    return clean.quality_missing(_subs(spark, sf, True))


def q_quality_dtypes(spark, sf):
    return clean.quality_dtypes(_subs(spark, sf, True))


def q_quality_numeric_summary(spark, sf):
    df = clean.quality_numeric_summary(clean.clean_total_charges(_subs(spark, sf)))
    return df.select("column_name", "count",
                     *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


# ------------------------------------------------------------------ filters / projections

FILTER = dict(network_qualities=[1, 2], tenure_range=(12, 72), charges_range=(10.0, 80.0),
              sentiment_range=(-1.0, 1.0))


def q_filter_customers(spark, sf):
    return sel.filter_customers(_prepared(spark, sf), **FILTER).select(
        S.ID_COLUMN, "network_quality", "tenure", "MonthlyCharges", "sentiment_score")


def q_filter_bounds(spark, sf):
    df = sel.filter_bounds(_structured(spark, sf))
    return df.withColumn("network_qualities", F.array_join(F.col("network_qualities").cast("array<string>"), ","))


def q_filtered_count(spark, sf):
    df = _prepared(spark, sf)
    pred = (F.col("network_quality").isin(FILTER["network_qualities"])
            & F.col("tenure").between(*FILTER["tenure_range"])
            & F.col("MonthlyCharges").between(*FILTER["charges_range"])
            & F.col("sentiment_score").between(*FILTER["sentiment_range"]))
    return sel.filtered_count(df, pred)


def q_preview(spark, sf):
    return sel.preview(_subs(spark, sf), 10)


def q_feature_target_split(spark, sf):
    return sel.feature_target_split(_structured(spark, sf))


def q_drop_non_model_columns(spark, sf):
    return sel.drop_non_model_columns(_prepared(spark, sf))


def q_churn_to_numeric(spark, sf):
    return sel.churn_to_numeric(_subs(spark, sf)).select(S.ID_COLUMN, S.TARGET_COLUMN)


def q_network_quality_label(spark, sf):
    return sel.with_network_quality_label(_structured(spark, sf)).select(
        S.ID_COLUMN, "network_quality", "network_quality_label")


# ------------------------------------------------------------------ structured features

def _feature_q(*cols):
    def run(spark, sf):
        return _structured(spark, sf).select(S.ID_COLUMN, *cols)
    return run


def q_polynomial_features(spark, sf):
    df = _structured(spark, sf).select(S.ID_COLUMN, "tenure", "MonthlyCharges")
    return features.polynomial_features(df, ["tenure", "MonthlyCharges"], 2)


def q_feature_pipeline(spark, sf):
    return _prepared(spark, sf)


# ------------------------------------------------------------------ text

def _text_q(*cols):
    def run(spark, sf):
        return _prepared(spark, sf).select(S.ID_COLUMN, *cols)
    return run


# keyword lists whose terms occur in the synthetic corpus (the reference lists never do)
CORPUS_KEYWORDS = dict(network=["tion", "ouen"], billing=["eau", "ble"],
                       service=["worthless", "stupid", "idiot"])


def q_keyword_flags_corpus(spark, sf):
    df = text.clean_text(_structured_text(spark, sf))
    return text.keyword_flags(df, **CORPUS_KEYWORDS).select(
        S.ID_COLUMN, "complaint_network", "complaint_billing", "complaint_service")


def _structured_text(spark, sf):
    return pipeline.memoized(spark, sf, "cleaned-text", lambda: pipeline.cleaned(_subs(spark, sf, True), adapters.SUBSCRIBER_ORDER))


def q_sentiment_by_class(spark, sf):
    return explore.histogram_by_class(_prepared(spark, sf), ["sentiment_score"])


def _tfidf(spark, sf):
    from churnlake.session import materialize
    split = pipeline.memoized(spark, sf, "text-split", lambda: materialize(_split(spark, sf), "text_split"))
    model = pipeline.memoized(spark, sf, "tfidf-model",
                              lambda: text.TfidfModel.fit(split.where(F.col("split") == "train")))
    return model, split


def q_tfidf_vocabulary(spark, sf):
    model, _ = _tfidf(spark, sf)
    return model.vocabulary.select("term", "tf", "df", F.round("idf", 6).alias("idf"))


def q_tfidf_features(spark, sf):
    model, split = _tfidf(spark, sf)
    return model.transform_long(split).select(S.ID_COLUMN, "term", F.round("tfidf", 6).alias("tfidf"))


def q_tfidf_top_terms(spark, sf):
    model, _ = _tfidf(spark, sf)
    return model.top_terms(20).select("term", F.round("idf_score", 6).alias("idf_score"))


def q_term_frequency(spark, sf):
    df = _prepared(spark, sf)
    churned = df.where(F.col(S.TARGET_COLUMN) == "Yes")
    return text.term_frequency(churned, top_n=80)


def q_complaint_breakdown(spark, sf):
    df = text.clean_text(_structured_text(spark, sf))
    return text.complaint_breakdown(text.keyword_flags(df, **CORPUS_KEYWORDS))


def q_complaint_preview(spark, sf):
    return text.complaint_preview(_subs(spark, sf, True)).select(S.ID_COLUMN, "complaint_preview")


# ------------------------------------------------------------------ EDA

def q_churn_rate_by_feature(spark, sf):
    return explore.churn_rate_by_feature(_structured(spark, sf), "tenure_bracket")


def q_histogram_by_class(spark, sf):
    return explore.histogram_by_class(_structured(spark, sf), ["MonthlyCharges"])


CORR_COLS = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "network_quality",
             "service_bundle_count", "avg_monthly_charges"]


def q_correlation_matrix(spark, sf):
    return explore.correlation_matrix(_structured(spark, sf), CORR_COLS)


def q_overall_churn_rate(spark, sf):
    return explore.overall_churn_rate(_subs(spark, sf))


def q_segment_report(spark, sf):
    return explore.segment_report(_structured(spark, sf))


def q_negative_sentiment_churn(spark, sf):
    return explore.churn_rate_by_feature(_prepared(spark, sf), "sentiment_negative")


def q_numeric_distributions(spark, sf):
    return explore.histogram_by_class(_structured(spark, sf), ["tenure", "MonthlyCharges", "TotalCharges"])


# ------------------------------------------------------------------ encoding / split

def q_encode_binary(spark, sf):
    return encode.encode_binary(_subs(spark, sf)).select(S.ID_COLUMN, *S.BINARY_COLUMNS)


def q_encode_senior(spark, sf):
    return encode.encode_senior(_subs(spark, sf)).select(S.ID_COLUMN, "SeniorCitizen")


def q_onehot_encode(spark, sf):
    df = _subs(spark, sf)
    oh = encode.OneHot.fit(df)
    return oh.transform(df).select(S.ID_COLUMN, *oh.output_columns())


def _scaled(spark, sf):
    split = sample.stratified_split(_structured(spark, sf))
    scaler = encode.Scaler.fit(split.where(F.col("split") == "train"))
    return scaler, scaler.transform(split)


def q_standard_scale(spark, sf):
    scaler, df = _scaled(spark, sf)
    return df.select(S.ID_COLUMN, "split", *[F.round(c, 6).alias(c) for c in scaler.stats])


def q_stratified_split(spark, sf):
    return _split(spark, sf).select(S.ID_COLUMN, S.TARGET_COLUMN, "split")


def q_split_report(spark, sf):
    return sample.split_report(_split(spark, sf))


def q_row_sample(spark, sf):
    return sample.row_sample(_subs(spark, sf), 200).select(S.ID_COLUMN, "tenure", "MonthlyCharges")


def q_cv_folds(spark, sf):
    return sample.cv_folds(_subs(spark, sf)).select(S.ID_COLUMN, S.TARGET_COLUMN, "fold")


# ------------------------------------------------------------------ evaluation

def q_apply_threshold(spark, sf):
    return evaluate.apply_threshold(_scored(spark, sf)).select("id", "y_pred")


def q_confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_scored(spark, sf))


def q_classification_metrics(spark, sf):
    return evaluate.classification_metrics(_scored(spark, sf))


def q_classification_report(spark, sf):
    return evaluate.classification_report(_scored(spark, sf))


def q_threshold_metrics(spark, sf):
    return evaluate.threshold_metrics(_scored(spark, sf))


def q_roc_auc(spark, sf):
    return evaluate.roc_auc(_scored(spark, sf))


def q_roc_curve(spark, sf):
    return evaluate.roc_curve(_models(spark, sf), by="model")


def q_pr_curve(spark, sf):
    return evaluate.pr_curve(_scored(spark, sf))


def q_pr_auc(spark, sf):
    return evaluate.pr_auc(_scored(spark, sf))


def q_calibration_curve(spark, sf):
    return evaluate.calibration_curve(_scored(spark, sf))


def q_gains_table(spark, sf):
    return evaluate.gains_table(_scored(spark, sf))


def q_lift_by_decile(spark, sf):
    return evaluate.lift_by_decile(_scored(spark, sf))


def q_cost_evaluation(spark, sf):
    return evaluate.cost_evaluation(_scored(spark, sf))


def q_model_comparison(spark, sf):
    return evaluate.model_comparison(_models(spark, sf))


def q_best_model(spark, sf):
    return evaluate.best_model(evaluate.model_comparison(_models(spark, sf)))


# ------------------------------------------------------------------ roster

def q_risk_tier(spark, sf):
    return roster.risk_tier(_scored(spark, sf)).select("id", "churn_probability", "risk_tier")


def q_high_risk_roster(spark, sf):
    df = _structured(spark, sf)
    return roster.high_risk_roster(df.withColumn("p", SCORER.probability()), top_n=20)


def q_roster_for_test_split(spark, sf):
    split = sample.stratified_split(pipeline.subscribers_structured(spark, sf, with_text=True))
    test = split.where(F.col("split") == "test").withColumn("p", SCORER.probability())
    return roster.roster_for_split(test, top_n=50)


# ------------------------------------------------------------------ explain (linear)

def _shap_long(spark, sf):
    df = _structured(spark, sf)
    return explain.shap_linear(df, SCORER), df


def q_shap_linear(spark, sf):
    s, _ = _shap_long(spark, sf)
    return s.select(S.ID_COLUMN, "feature", "value", F.round("shap", 6).alias("shap"))


def q_shap_global(spark, sf):
    s, _ = _shap_long(spark, sf)
    return explain.shap_global(s).select("feature", F.round("mean_abs_shap", 6).alias("mean_abs_shap"))


def q_shap_summary(spark, sf):
    s, _ = _shap_long(spark, sf)
    return explain.shap_summary(s).select(S.ID_COLUMN, "feature", "value", F.round("shap", 6).alias("shap"))


WATERFALL_CUSTOMER = "7"


def q_shap_waterfall(spark, sf):
    s, df = _shap_long(spark, sf)
    base = explain.base_value(df, SCORER)
    w = explain.shap_waterfall(s, WATERFALL_CUSTOMER, base)
    return w.select("rank", "feature", "value", F.round("shap", 6).alias("shap"),
                    F.round("cumulative", 6).alias("cumulative"))


def q_shap_customer_top(spark, sf):
    t = explain.shap_customer_top(explain.shap_linear_rows(_structured(spark, sf), SCORER), top_n=2)
    return t.select(S.ID_COLUMN, "rank", "feature", "value", F.round("shap_value", 6).alias("shap_value"),
                    "direction")


def q_partial_dependence(spark, sf):
    return explain.partial_dependence(_structured(spark, sf), SCORER, ["tenure", "MonthlyCharges"])


def q_ice_curves(spark, sf):
    return explain.ice_curves(_structured(spark, sf), SCORER, "tenure", sample_n=100)


def q_score_customers(spark, sf):
    df = _structured(spark, sf)
    return df.select(S.ID_COLUMN, F.round(SCORER.probability(), 6).alias("p"))


QUERIES = {
    "load_customers": q_load_customers,
    "load_checked": q_load_checked,
    "missing_columns": q_missing_columns,
    "save_versioned": q_save_versioned,
    "save_roster": q_save_roster,
    "save_model_comparison": q_save_model_comparison,
    "clean_total_charges": q_clean_total_charges,
    "imputed_count": q_imputed_count,
    "dedup_customers": q_dedup_customers,
    "quality_shape": q_quality_shape,
    "quality_missing": q_quality_missing,
    "quality_dtypes": q_quality_dtypes,
    "quality_numeric_summary": q_quality_numeric_summary,
    "filter_customers": q_filter_customers,
    "filter_bounds": q_filter_bounds,
    "filtered_count": q_filtered_count,
    "preview": q_preview,
    "feature_target_split": q_feature_target_split,
    "drop_non_model_columns": q_drop_non_model_columns,
    "churn_to_numeric": q_churn_to_numeric,
    "network_quality_label": q_network_quality_label,
    "network_quality": _feature_q("network_quality"),
    "interaction_features": _feature_q("tenure_network_interaction", "charges_network_interaction"),
    "polynomial_features": q_polynomial_features,
    "service_bundle_count": _feature_q("service_bundle_count"),
    "high_value_customer": _feature_q("MonthlyCharges", "high_value_customer"),
    "tenure_bracket": _feature_q("tenure", "tenure_bracket", "tenure_bracket_encoded"),
    "avg_monthly_charges": _feature_q("avg_monthly_charges"),
    "recent_contract_change": _feature_q("recent_contract_change"),
    "feature_pipeline": q_feature_pipeline,
    "clean_text": _text_q("complaint_text_clean"),
    "sentiment_score": _text_q("sentiment_score"),
    "sentiment_flags": _text_q("sentiment_negative", "sentiment_positive"),
    "sentiment_by_class": q_sentiment_by_class,
    "keyword_flags": _text_q("complaint_network", "complaint_billing", "complaint_service"),
    "keyword_flags_corpus": q_keyword_flags_corpus,
    "tfidf_vocabulary": q_tfidf_vocabulary,
    "tfidf_features": q_tfidf_features,
    "tfidf_top_terms": q_tfidf_top_terms,
    "term_frequency": q_term_frequency,
    "complaint_breakdown": q_complaint_breakdown,
    "complaint_preview": q_complaint_preview,
    "encode_binary": q_encode_binary,
    "encode_senior": q_encode_senior,
    "onehot_encode": q_onehot_encode,
    "standard_scale": q_standard_scale,
    "stratified_split": q_stratified_split,
    "split_report": q_split_report,
    "row_sample": q_row_sample,
    "cv_folds": q_cv_folds,
    "churn_rate_by_feature": q_churn_rate_by_feature,
    "histogram_by_class": q_histogram_by_class,
    "correlation_matrix": q_correlation_matrix,
    "overall_churn_rate": q_overall_churn_rate,
    "segment_report": q_segment_report,
    "negative_sentiment_churn": q_negative_sentiment_churn,
    "numeric_distributions": q_numeric_distributions,
    "apply_threshold": q_apply_threshold,
    "confusion_matrix": q_confusion_matrix,
    "classification_metrics": q_classification_metrics,
    "classification_report": q_classification_report,
    "threshold_metrics": q_threshold_metrics,
    "roc_auc": q_roc_auc,
    "roc_curve": q_roc_curve,
    "pr_curve": q_pr_curve,
    "pr_auc": q_pr_auc,
    "calibration_curve": q_calibration_curve,
    "gains_table": q_gains_table,
    "lift_by_decile": q_lift_by_decile,
    "cost_evaluation": q_cost_evaluation,
    "model_comparison": q_model_comparison,
    "best_model": q_best_model,
    "risk_tier": q_risk_tier,
    "high_risk_roster": q_high_risk_roster,
    "roster_for_test_split": q_roster_for_test_split,
    "score_customers": q_score_customers,
    "shap_linear": q_shap_linear,
    "shap_global": q_shap_global,
    "shap_summary": q_shap_summary,
    "shap_waterfall": q_shap_waterfall,
    "shap_customer_top": q_shap_customer_top,
    "partial_dependence": q_partial_dependence,
    "ice_curves": q_ice_curves,
}


# ------------------------------------------------------------------ models (rows-only checks)

def _matrix(spark, sf):
    from churnlake.plans import modeling
    return pipeline.memoized(spark, sf, "model-matrix", lambda: modeling.model_matrix(spark, sf))


def q_class_weights(spark, sf):
    from churnlake.operators import models
    w = models.class_weights(_subs(spark, sf))
    return w.select("label", "count", F.round("balanced_weight", 6).alias("balanced_weight"),
                    F.round("scale_pos_weight", 6).alias("scale_pos_weight"))


def q_train_logistic(spark, sf):
    from churnlake.operators import models
    from churnlake.plans import modeling
    m = _matrix(spark, sf)
    return models.coefficients(modeling.fitted(m, "logistic"), m.features)


def _scores(name):
    def run(spark, sf):
        from churnlake.plans import modeling
        m = _matrix(spark, sf)
        return modeling.scored_test(modeling.fitted(m, name), m)
    return run


def _tuned(kind, n):
    def run(spark, sf):
        from churnlake.operators import models
        m = _matrix(spark, sf)
        train = m.scaler.transform(m.train) if kind == "logistic" else m.train
        return models.tune(kind, train, m.features, n)[1]
    return run


def _watched(spark, sf):
    """Boosting on four fifths of the training rows, and the fifth that its curve is taken on."""
    from churnlake.operators import boosting
    m = _matrix(spark, sf)

    def build():
        held = sample.stratified_split(m.train.drop("split"), target="label", seed=S.SEED + 1)
        watched = held.where("split = 'test'")
        model = boosting.fit(held.where("split = 'train'"), m.features)
        return model, watched, boosting.evaluation_curve(model, watched)
    return m, *pipeline.memoized(spark, sf, "watched-boosting", build)


def q_evaluation_curve(spark, sf):
    return _watched(spark, sf)[3].select("iteration", F.round("log_loss", 6).alias("log_loss"), "roc_auc")


def q_evaluation_curve_end(spark, sf):
    """The last point of the curve is the area of the whole model over the same rows."""
    _, model, watched, curve = _watched(spark, sf)
    last = curve.orderBy(F.desc("iteration")).limit(1)
    whole = evaluate.roc_auc(model.probability(watched, [S.ID_COLUMN, "label"]).select(F.col("label").cast("int").alias("y"), "p"))
    return last.crossJoin(whole.select(F.col("roc_auc").alias("whole"))).select(  # one row each
        "iteration", (F.col("roc_auc") == F.col("whole")).alias("same_area"))


def q_validation_fit(spark, sf):
    """The prefix of least log loss on the watched rows; the area is that of the test rows, which it never saw."""
    m, model, _, curve = _watched(spark, sf)
    used = curve.orderBy("log_loss", "iteration").first()["iteration"]
    scored = model.prefix(used).probability(m.test, [S.ID_COLUMN, "label"])
    auc = evaluate.roc_auc(scored.select(F.col("label").cast("int").alias("y"), "p"))
    return auc.select(F.lit(used).alias("trees_used"), "roc_auc")


#: Features of the model matrix that SQL has without encoding.
ROOT_FEATURES = ["tenure", "MonthlyCharges", "TotalCharges", "network_quality", "tenure_network_interaction",
                 "charges_network_interaction", "service_bundle_count", "avg_monthly_charges"]


def q_boosting_root_splits(spark, sf):
    from churnlake.operators import boosting
    splits = boosting.root_splits(_matrix(spark, sf).train, ROOT_FEATURES)
    return splits.select("feature", F.round("threshold", 4).alias("threshold"), F.round("gain", 3).alias("gain"),
                         F.round("left_gradient", 3).alias("left_gradient"), F.round("left_hessian", 3).alias("left_hessian"))


def _all_scores(spark, sf):
    from churnlake.plans import modeling
    return modeling.scores_of(_matrix(spark, sf), {
        "logistic_regression": "logistic", "random_forest": "forest", "gradient_boosting": "gbt"})


def q_train_all(spark, sf):
    return evaluate.model_comparison(_all_scores(spark, sf))


def q_feature_importance(spark, sf):
    from churnlake.operators import models
    from churnlake.plans import modeling
    m = _matrix(spark, sf)
    return models.feature_importance(modeling.fitted(m, "forest"), m.features, top_n=20)


def q_model_roundtrip(spark, sf):
    from churnlake.operators import models
    from churnlake.plans import modeling
    m = _matrix(spark, sf)
    model = modeling.fit_logistic(m)
    fp = models.Fingerprint.of(m.train, m.features, {"model": "roundtrip", "C": 1.0})
    path = models.save_model(model, models.model_path(m.train, "roundtrip", fp), fp)
    again = models.load_model(path, fp)
    before = modeling.scored_test(model, m, scaled=True).withColumnRenamed("p", "p_before")
    after = modeling.scored_test(again, m, scaled=True).select(S.ID_COLUMN, F.col("p").alias("p_after"))
    return before.join(after, S.ID_COLUMN).withColumn("equal", F.col("p_before") == F.col("p_after"))


# ---- a trained model explained, and the facts that SQL can check

def _tree_rows(spark, sf):
    from churnlake.operators import treeshap
    from churnlake.plans import modeling
    from churnlake.session import materialize
    m = _matrix(spark, sf)
    return pipeline.memoized(spark, sf, "tree-shap", lambda: materialize(
        treeshap.shap_tree_rows(m.test, modeling.fitted(m, "gbt"), m.features), "tree-shap"))


def _tree_long(spark, sf):
    return _tree_rows(spark, sf).select(S.ID_COLUMN, F.explode("shap").alias("s"), "base_value", "margin").select(
        S.ID_COLUMN, "s.feature", "s.value", "s.shap", "base_value", "margin")


def q_shap_tree_global(spark, sf):
    return explain.shap_global(_tree_long(spark, sf))


def q_shap_tree_summary(spark, sf):
    return explain.shap_summary(_tree_long(spark, sf).drop("base_value", "margin"))


def q_shap_tree_top(spark, sf):
    return explain.shap_customer_top(_tree_rows(spark, sf))


def q_shap_tree_waterfall(spark, sf):
    rows = _tree_long(spark, sf)
    one = rows.orderBy(F.desc("margin"), S.ID_COLUMN).select(S.ID_COLUMN, "base_value").first()
    return explain.shap_waterfall(rows.drop("base_value", "margin"), one[0], one[1])


def q_shap_tree_additive(spark, sf):
    total = F.aggregate("shap", F.col("base_value"), lambda a, s: a + s["shap"])
    return _tree_rows(spark, sf).select(S.ID_COLUMN, (F.abs(total - F.col("margin")) < 1e-9).alias("additive"))


def _gbt_nodes(spark, sf):
    from churnlake.operators import treeshap
    from churnlake.plans import modeling
    m = _matrix(spark, sf)
    return m, explain.TreeScorer(treeshap.ensemble_of(modeling.fitted(m, "gbt")), m.features)


def q_partial_dependence_model(spark, sf):
    m, scorer = _gbt_nodes(spark, sf)
    return explain.partial_dependence(m.test, scorer, ["tenure", "MonthlyCharges"])


def q_ice_curves_model(spark, sf):
    m, scorer = _gbt_nodes(spark, sf)
    return explain.ice_curves(m.test, scorer, "tenure")


def q_roster_trained(spark, sf):
    """The riskiest 20 test customers of the trained boosting model, with their readable attributes."""
    from churnlake.plans import modeling
    m = _matrix(spark, sf)
    scores = modeling.scored_test(modeling.fitted(m, "gbt"), m).select(S.ID_COLUMN, "p")
    return roster.roster_for_split(_prepared(spark, sf).join(scores, S.ID_COLUMN), top_n=20)


def q_gains_trained(spark, sf):
    return evaluate.gains_table(_all_scores(spark, sf).where(F.col("model") == "gradient_boosting").drop("model"))


def q_cost_trained(spark, sf):
    return evaluate.cost_evaluation(_all_scores(spark, sf).where(F.col("model") == "gradient_boosting").drop("model"))


#: Areas over the training rows that only a model of these rows reaches: a constant has 0.5.
LEARNT = {"logistic": 0.5, "forest": 0.9, "gbt": 0.7, "gbt_light": 0.7}


def q_models_learn(spark, sf):
    """Each trained model ranks its own training rows better than chance, the trees far better."""
    from churnlake.plans import modeling
    m, parts = _matrix(spark, sf), []
    for name in LEARNT:
        rows = modeling.scored_rows(modeling.fitted(m, name), m, m.train, scaled=name == "logistic")
        parts.append(rows.select(F.lit(name).alias("model"), "y", "p"))
    scores = functools.reduce(lambda a, b: a.unionByName(b), parts)
    need = functools.reduce(lambda c, i: c.when(F.col("model") == i[0], i[1]), LEARNT.items(), F.when(F.lit(False), 0.0))
    sizes = scores.groupBy("model").agg(F.count(F.lit(1)).alias("n_train"))
    return evaluate.roc_auc(scores, by="model").join(sizes, "model").select("model", "n_train", (F.col("roc_auc") > need).alias("learnt"))


def q_logistic_optimum(spark, sf):
    from churnlake.plans import modeling
    return modeling.gradient_norm(_matrix(spark, sf)).select("n_train", (F.col("gradient") < 1e-2).alias("stationary"))


def q_logistic_scorer(spark, sf):
    """The fitted regression as a linear scorer gives the model's own probabilities."""
    from churnlake.plans import modeling
    m = _matrix(spark, sf)
    own = modeling.scored_test(modeling.fitted(m, "logistic"), m, scaled=True).select(S.ID_COLUMN, "p")
    linear = m.test.select(S.ID_COLUMN, modeling.linear_scorer(m).probability().alias("q"))
    return own.join(linear, S.ID_COLUMN).select(S.ID_COLUMN, (F.abs(F.col("p") - F.col("q")) < 1e-9).alias("equal"))


def q_model_roundtrip_equal(spark, sf):
    return q_model_roundtrip(spark, sf).select(S.ID_COLUMN, "equal")


def q_importance_identity(spark, sf):
    """The impurity that the splits of a tree take away, which importances are made of, is that of its root without that of its leaves."""
    from churnlake.plans import modeling

    def adds_up(f):
        return bool(abs(f.gains.sum() - (f.root - f.leaves)) < 1e-6 * max(1.0, f.root)) and f.splits > 0

    facts = modeling.fitted(_matrix(spark, sf), "forest").facts()
    return spark.createDataFrame([(i, adds_up(f)) for i, f in enumerate(facts)], "tree int, adds_up boolean")


def q_tfidf_wide(spark, sf):
    model, split = _tfidf(spark, sf)
    wide = model.transform(split)
    names = [c for c in wide.columns if c.startswith("tfidf_")]
    pairs = F.array(*[F.struct(F.lit(c[6:]).alias("term"), F.round(F.col(f"`{c}`"), 6).alias("tfidf")) for c in names])
    return wide.select(S.ID_COLUMN, F.explode(pairs).alias("t")).select(S.ID_COLUMN, "t.term", "t.tfidf")


def q_shap_tree(spark, sf):
    return _tree_long(spark, sf)


QUERIES.update({
    "class_weights": q_class_weights,
    "train_logistic": q_train_logistic,
    "train_forest": _scores("forest"),
    "train_gbt": _scores("gbt"),
    "train_gbt_light": _scores("gbt_light"),
    "tune_models": _tuned("logistic", None),
    "tune_forest": _tuned("forest", None),
    "tune_boosting": _tuned("gbt", None),
    "validation_fit": q_validation_fit,
    "evaluation_curve": q_evaluation_curve,
    "evaluation_curve_end": q_evaluation_curve_end,
    "boosting_root_splits": q_boosting_root_splits,
    "train_all": q_train_all,
    "feature_importance": q_feature_importance,
    "model_roundtrip": q_model_roundtrip,
    "shap_tree": q_shap_tree,
    "shap_tree_global": q_shap_tree_global,
    "shap_tree_summary": q_shap_tree_summary,
    "shap_tree_top": q_shap_tree_top,
    "shap_tree_waterfall": q_shap_tree_waterfall,
    "shap_tree_additive": q_shap_tree_additive,
    "partial_dependence_model": q_partial_dependence_model,
    "ice_curves_model": q_ice_curves_model,
    "roster_trained": q_roster_trained,
    "gains_trained": q_gains_trained,
    "cost_trained": q_cost_trained,
    "models_learn": q_models_learn,
    "logistic_optimum": q_logistic_optimum,
    "logistic_scorer": q_logistic_scorer,
    "model_roundtrip_equal": q_model_roundtrip_equal,
    "importance_identity": q_importance_identity,
    "tfidf_wide": q_tfidf_wide,
})
