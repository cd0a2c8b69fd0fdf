"""Golden edge rows (FIXTURES.md section 2) with literal expected values."""

import math

import pytest
from pyspark.sql import functions as F

from churnlake.operators import clean, encode, evaluate, explore, features, roster, text
from churnlake.operators.rank import exact_quantiles
from churnlake.sources import io


def _rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_total_charges(spark):
    df = spark.createDataFrame(
        [("a", " ", 3, 20.0), ("b", "1e3", 1, 1.0), ("c", " 5 ", 1, 1.0), ("d", "1,000", 2, 2.0),
         ("e", "1d", 2, 2.0), ("f", "nan", 2, 2.0), ("g", None, 4, 1.5)],
        "customerID string, TotalCharges string, tenure int, MonthlyCharges double")
    out = dict(_rows(clean.clean_total_charges(df), "customerID", "TotalCharges"))
    assert out == {"a": 60.0, "b": 1000.0, "c": 5.0, "d": 4.0, "e": 4.0, "f": 4.0, "g": 6.0}
    assert clean.imputed_count(df).first()["imputed"] == 5


def test_tenure_bracket_and_avg(spark):
    df = spark.createDataFrame([(t,) for t in [0, 1, 12, 13, 60, 61]], "tenure int")
    got = _rows(features.tenure_bracket(df), "tenure", "tenure_bracket", "tenure_bracket_encoded")
    assert sorted(got) == [(0, "0-12", 0), (1, "0-12", 0), (12, "0-12", 0), (13, "13-24", 1),
                           (60, "49-60", 4), (61, "60+", 5)]
    strict = dict(_rows(features.tenure_bracket(df, strict=True), "tenure", "tenure_bracket"))
    assert strict[0] is None
    d2 = spark.createDataFrame([(0, 0.0, 45.5), (10, 100.0, 1.0)],
                               "tenure int, TotalCharges double, MonthlyCharges double")
    assert sorted(_rows(features.avg_monthly_charges(d2), "avg_monthly_charges")) == [(10.0,), (45.5,)]


def test_network_quality_column(spark):
    df = spark.createDataFrame([("1.9",), ("x",), (None,), ("-1.5",)], "network_quality string")
    assert [r[0] for r in features.network_quality(df).collect()] == [1, 0, 0, -1]
    d2 = spark.createDataFrame([("DSL",), ("Fiber optic",), ("No",), ("Cable",)], "InternetService string")
    assert [r["network_quality"] for r in features.network_quality(d2).collect()] == [1, 2, 0, 0]


def test_quantile(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 10]], "MonthlyCharges double")
    assert exact_quantiles(df, "MonthlyCharges", [0.75]) == [4.75]
    hv = features.HighValue.fit(df)
    assert [r["high_value_customer"] for r in hv.transform(df).orderBy("MonthlyCharges").collect()] == [0, 0, 0, 1]


def test_dedup_first_and_null_ids(spark):
    df = spark.createDataFrame([("x", 2, "late"), ("x", 1, "early"), (None, 5, "n1"), (None, 3, "n2")],
                               "customerID string, ts int, v string")
    out = sorted(_rows(clean.dedup_first(df, ["ts"], "customerID"), "customerID", "v"),
                 key=lambda r: (r[0] is None, r[0]))
    assert out == [("x", "early"), (None, "n2")]


def test_onehot_drops_first_and_null_is_zero(spark):
    df = spark.createDataFrame([("1", "b"), ("2", None), ("3", "a")], "customerID string, c string")
    oh = encode.OneHot.fit(df, ["c"])
    assert oh.output_columns() == ["c_b"]
    assert dict(_rows(oh.transform(df), "customerID", "c_b")) == {"1": 1, "2": 0, "3": 0}


@pytest.mark.parametrize("raw,expected", [
    ("See http://a.b/c now 4G is NOT the @علي best!", "see now best"),
    ("@user_1 Naïve www.x.y z bb", "na ve bb"),
    (None, ""), ("", ""), ("   ", ""),
])
def test_clean_text(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "complaint_text string")
    assert text.clean_text(df).first()["complaint_text_clean"] == expected


def test_keywords_are_substrings_and_digits_never_match(spark):
    df = spark.createDataFrame([("billing slow 4g",)], "complaint_text string")
    r = text.keyword_flags(text.clean_text(df)).first()
    assert (r["complaint_network"], r["complaint_billing"], r["complaint_service"]) == (1, 1, 0)


def test_risk_tier_and_rounding(spark):
    df = spark.createDataFrame([(0.0,), (0.00004,), (0.4,), (0.40001,), (1.0,), (0.12345,)], "p double")
    got = _rows(roster.risk_tier(df), "p", "churn_probability", "risk_tier")
    assert got == [(0.0, 0.0, None), (0.00004, 0.0, None), (0.4, 0.4, "Low"), (0.40001, 0.4, "Low"),
                   (1.0, 1.0, "Critical"), (0.12345, 0.1234, "Low")]


def test_histogram_min_equals_max(spark):
    df = spark.createDataFrame([(5.0, "Yes"), (5.0, "Yes")], "x double, Churn string")
    r = explore.histogram_by_class(df, ["x"]).where("count > 0").first()
    # range widened to 4.5..5.5, so 5.0 lands in bin 15 = [5.0, 5.0333)
    assert (r["bin_start"], r["bin_end"], r["count"], r["bin"]) == (5.0, pytest.approx(5.033333), 2, 15)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.1, 0), (2, 0.4, 0), (3, 0.4, 1), (4, 0.35, 1), (5, 0.8, 1)],
                               "id long, p double, y int")
    assert evaluate.roc_auc(df).first()["roc_auc"] == 0.75


def test_deciles_follow_quantile_formula(spark):
    n = 12
    df = spark.createDataFrame([(i, 1.0 - i / 100, i % 2) for i in range(n)], "id long, p double, y int")
    g = evaluate.gains_table(df).orderBy("decile").collect()
    expected = {}
    for i in range(n):
        d = max(math.ceil(10 * i / (n - 1)) - 1, 0)
        expected[d] = expected.get(d, 0) + 1
    assert {r["decile"]: r["customers"] for r in g} == expected
    assert g[-1]["pct_churners_captured"] == 1.0


def test_no_positive_prediction_and_one_class(spark):
    low = spark.createDataFrame([(1, 0.1, 1), (2, 0.2, 0)], "id long, p double, y int")
    assert evaluate.classification_metrics(low).first()["precision"] == 0.0
    one = spark.createDataFrame([(1, 0.1, 0), (2, 0.7, 0)], "id long, p double, y int")
    assert evaluate.roc_auc(one).first()["roc_auc"] is None
    assert evaluate.cost_evaluation(one).first()["baseline_cost_no_model"] == 0.0
    assert all(r["pct_churners_captured"] is None for r in evaluate.gains_table(one).collect())
    cm = evaluate.confusion_matrix(one).first()
    assert (cm["tn"], cm["fp"], cm["fn"], cm["tp"]) == (1, 1, 0, 0)


def test_csv_columns_read_by_name(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("tenure,customerID,MonthlyCharges\n5,a,1.5\n")
    df = io.load_customers(spark, str(p))
    r = df.first()
    assert (r["customerID"], r["tenure"], r["MonthlyCharges"]) == ("a", 5, 1.5)
    assert dict(df.dtypes)["tenure"] == "int"


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(Exception):
        io.load_customers(spark, str(tmp_path / "nope.csv")).count()


def test_empty_upload_raises(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text("tenure,MonthlyCharges\n")
    with pytest.raises(ValueError):
        io.load_checked(spark, str(p))


def test_binary_encoding_accepts_numeric_churn(spark):
    df = spark.createDataFrame([("Male", "Yes"), ("Female", "0"), ("x", "1")], "gender string, Churn string")
    got = _rows(encode.encode_binary(df), "gender", "Churn")
    assert got == [(1, 1), (0, 0), (None, 1)]
    with pytest.raises(Exception):
        encode.encode_binary(df, strict=True).collect()


def test_polynomial_names(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    out = features.polynomial_features(df, ["a", "b"])
    assert out.columns == ["a", "b", "a^2", "a b", "b^2"]
    assert tuple(out.first()) == (2.0, 3.0, 4.0, 6.0, 9.0)


def test_scaler_uses_population_std_and_zero_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "tenure double, MonthlyCharges double")
    sc = encode.Scaler.fit(df, ["tenure", "MonthlyCharges"])
    rows = sc.transform(df).orderBy("tenure").collect()
    assert [r["tenure"] for r in rows] == [-1.0, 1.0]
    assert [r["MonthlyCharges"] for r in rows] == [0.0, 0.0]
    assert F is not None


def test_tfidf_weights_match_formula(spark):
    df = spark.createDataFrame([("1", "aa bb aa"), ("2", "aa cc"), ("3", "bb aa")],
                               "customerID string, complaint_text_clean string")
    model = text.TfidfModel.fit(df)
    vocab = {r["term"]: (r["tf"], r["df"], r["idf"]) for r in model.vocabulary.collect()}
    assert vocab["aa"][:2] == (4, 3) and vocab["bb"][:2] == (2, 2) and "cc" not in vocab
    assert vocab["aa"][2] == pytest.approx(math.log(4 / 4) + 1)
    long = {(r["customerID"], r["term"]): r["tfidf"] for r in model.transform_long(df).collect()}
    assert vocab["bb aa"][:2] == (2, 2)  # bigrams count too
    wa = (1 + math.log(2)) * vocab["aa"][2]
    wb, wab = vocab["bb"][2], vocab["bb aa"][2]
    assert long[("1", "aa")] == pytest.approx(wa / math.sqrt(wa * wa + wb * wb + wab * wab))
    wide = model.transform(df).orderBy("customerID").collect()
    assert wide[1]["tfidf_aa"] == pytest.approx(1.0) and wide[1]["tfidf_bb"] == 0.0


def test_csv_as_pandas_writes_it(spark, tmp_path):
    import pandas as pd
    texts = ['He said "bad service", twice', "line one\nline two", 'a, "b", c', "plain"]
    frame = pd.DataFrame({"customerID": list("abcd"), "tenure": [3.0, float("nan"), 1.0, 2.5], "SeniorCitizen": [1.0, 0.0, 1.0, 0.0],
                          "MonthlyCharges": [1.5, float("nan"), 2.0, 3.0], "complaint_text": texts})
    path = str(tmp_path / "in.csv")
    frame.to_csv(path, index=False, na_rep="NaN")
    for df in (io.load_customers(spark, path), io.load_checked(spark, path)):
        rows = {r["customerID"]: r for r in df.collect()}
        assert [rows[c]["complaint_text"] for c in "abcd"] == texts
        assert [rows[c]["tenure"] for c in "abcd"] == [3, None, 1, None]
        assert [rows[c]["SeniorCitizen"] for c in "abcd"] == [1, 0, 1, 0]
        assert rows["b"]["MonthlyCharges"] is None
    out = io.save_versioned(io.load_customers(spark, path), str(tmp_path / "out"))
    assert sorted(r["complaint_text"] for r in io.load_customers(spark, out).collect()) == sorted(texts)


def test_versions_never_replace_each_other(spark, tmp_path):
    import datetime

    from pyspark.errors import AnalysisException
    df = spark.createDataFrame([(1,)], "a int")
    now = datetime.datetime(2024, 1, 1)
    io.save_versioned(df, str(tmp_path), ts=now)
    with pytest.raises(AnalysisException):
        io.save_versioned(df, str(tmp_path), ts=now)


def test_nan_is_missing(spark, tmp_path):
    nan = float("nan")
    rows = [("a", 1, nan), ("b", 2, 10.0), ("c", 3, 20.0), ("d", 4, 60.0)]
    df = spark.createDataFrame(rows, "customerID string, tenure int, MonthlyCharges double")
    df.write.parquet(str(tmp_path / "p"))
    assert io.load_customers(spark, str(tmp_path / "p"), "parquet").where("MonthlyCharges is null").count() == 1
    assert clean.quality_shape(df).first()["total_missing"] == 1
    assert dict(_rows(clean.quality_missing(df), "column_name", "missing"))["MonthlyCharges"] == 1
    summary = {r["column_name"]: r for r in clean.quality_numeric_summary(df).collect()}["MonthlyCharges"]
    assert (summary["count"], summary["mean"], summary["max"], summary["q50"]) == (3, 30.0, 60.0, 20.0)
    flags = dict(_rows(features.HighValue.fit(df).transform(df), "customerID", "high_value_customer"))
    assert flags == {"a": 0, "b": 0, "c": 0, "d": 1}
    assert encode.Scaler.fit(df, ["MonthlyCharges"]).stats["MonthlyCharges"][0] == 30.0
    r = explore.correlation_matrix(df, ["tenure", "MonthlyCharges"]).first()["r"]
    assert not math.isnan(r) and r > 0.9


def test_one_hot_takes_any_number_of_categories(spark):
    df = spark.range(1500).select(F.col("id").cast("string").alias("Contract"))
    assert len(encode.OneHot.fit(df, ["Contract"]).categories["Contract"]) == 1500


def test_filter_bounds_are_numbers(spark):
    from churnlake.operators import select
    df = spark.createDataFrame([(10, 1, 1.0), (2, 2, 2.0)], "network_quality int, tenure int, MonthlyCharges double")
    assert select.filter_bounds(df).first()["network_qualities"] == [2, 10]


def test_histogram_has_empty_bins(spark):
    df = spark.createDataFrame([(0.0, "Yes"), (30.0, "Yes"), (5.0, "No")], "x double, Churn string")
    rows = explore.histogram_by_class(df, ["x"]).collect()
    assert len(rows) == 60 and sum(r["count"] for r in rows) == 3


def test_dedup_needs_an_order(spark):
    df = spark.createDataFrame([("x", 1)], "customerID string, ts int")
    with pytest.raises(ValueError, match="first"):
        clean.dedup_first(df, [])
