import math

import pytest
from pyspark.sql import functions as F

from provenant.functions import stats
from provenant.operators import assoc, bins, cohort, decompose, profile, sanity, series
from provenant.operators.model import logit, metrics
from provenant.operators.model.tiers import TierPolicy


def emea(spark):
    rows = [("EMEA", "Q1", "Software", 700.0, 210.0), ("EMEA", "Q1", "Hardware", 300.0, 190.0), ("EMEA", "Q2", "Software", 620.0, 186.0), ("EMEA", "Q2", "Hardware", 380.0, 380 * 19 / 30)]
    return spark.createDataFrame(rows, "region string, quarter string, product_line string, revenue double, cogs double")


def test_margin_effects_sum_to_the_change(spark):
    e = decompose.decompose_margin(emea(spark), "product_line", "quarter", "Q1", "Q2")
    t = decompose.margin_totals(e).first()
    assert t["margin_1"] == pytest.approx(0.6) and abs(t["mix"] + t["rate"] + t["interaction"] - t["delta"]) < 1e-12
    assert t["dominant"] == "mix" and abs(t["rate"]) < 1e-9
    c = {r["segment"]: r for r in decompose.additive_contribution(emea(spark), "product_line", "quarter", "Q1", "Q2", "revenue").collect()}
    assert c["Software"]["delta"] == -80 and c["Hardware"]["delta"] == 80 and c["Software"]["contribution"] is None


def test_no_revenue_raises(spark):
    with pytest.raises(Exception, match="no revenue"):
        decompose.decompose_margin(emea(spark), "product_line", "quarter", "Q1", "Q9").collect()


def test_simpson(spark):
    rows = [("a", 1, 90.0, 100.0), ("b", 1, 10.0, 100.0), ("a", 2, 95.0, 100.0), ("b", 2, 150.0, 1000.0)]
    df = spark.createDataFrame(rows, "s string, p int, t double, b double")
    assert decompose.simpsons_check(df, "s", "p", 1, 2, "t", "b").first()["reversed"]


def test_sizing():
    out = decompose.size_opportunity([decompose.Assumption("n", 1000, 500, 1500), decompose.Assumption("r", 0.04, 0.03, 0.05), decompose.Assumption("v", 50, 50, 50)], decompose.product_model)
    assert out["value"] == pytest.approx(2000) and [x["assumption"] for x in out["tornado"]] == ["n", "r", "v"]
    assert decompose.margin_opportunity(-0.04, 1000)["value"] == pytest.approx(40)


def test_tails():
    assert stats.t_two_sided(2.1, 98) == pytest.approx(0.0383, abs=1e-4)
    assert stats.chi_square_tail(7.8147, 3) == pytest.approx(0.05, abs=1e-5)
    assert stats.chi_square_tail(1.0, 10) == pytest.approx(0.99983, abs=1e-5)
    assert stats.z_of(0.95, one_sided=True) == pytest.approx(1.6449, abs=1e-4)
    assert 0 < stats.proportions(900, 1000, 100, 1000).p_value < 1e-200
    assert 3500 < stats.sample_size(0.10, 0.02) * 0.925 < 3650 or 3500 <= stats.sample_size(0.10, 0.02) <= 3900
    assert stats.power_at(stats.sample_size(0.10, 0.02), 0.10, 0.02) == pytest.approx(0.8, abs=0.01)
    assert stats.wilson(0, 0) == (0.0, 0.0) and stats.wilson(10, 100)[0] == pytest.approx(0.0552, abs=1e-3)
    assert stats.odds_ratio(10, 0, 5, 5)["adjusted"] and stats.relative_risk(10, 100, 5, 100)["relative_risk"] == pytest.approx(2)
    assert stats.welch(30, 1.0, 1.0, 30, 1.0, 1.0).p_value == pytest.approx(1) and stats.cohens_d(50, 1.0, 1.0, 50, 0.0, 1.0)["d"] == pytest.approx(1)


def bucket(rates, n=1000):
    return [bins.Bucket(float(i), float(i), n, n * r) for i, r in enumerate(rates)]


@pytest.mark.parametrize("rates, kind", [([0.1] * 4 + [0.7] * 4, "cliff"), ([0.1 * k for k in range(1, 9)], "monotone"), ([0.3] * 8, "non_monotone"), ([0.1, 0.7], "insufficient")])
def test_thresholds(rates, kind):
    t = bins.detect_threshold(bucket(rates))
    assert t.kind == kind
    if kind == "cliff":
        assert t.cuts == (4.0,) and t.jump == pytest.approx(0.6) and t.ratio == pytest.approx(7)


def test_staircase_has_two_cuts():
    assert bins.detect_threshold(bucket([0.1] * 16 + [0.58] * 5 + [0.77] * 10)).cuts == (16.0, 21.0)
    assert bins.labels_of([21, 16]) == ["0-15", "16-20", "21+"] and bins.labels_of([]) == ["all"] and bins.labels_of([0.5, 2]) == ["<0.5", "0.5-2", "2+"]
    assert "WHEN \"x\" < 16 THEN '0-15'" in bins.bin_sql("x", [16, 21]) and "SWITCH" in bins.bin_dax("T", "x", [16])


@pytest.mark.parametrize("parts", [1, 7])
def test_ntile_matches_the_window(spark, parts):
    df = spark.range(103).select((F.col("id") % 9).alias("v"), (F.col("id") % 2).alias("y"), "id").repartition(parts)
    from pyspark.sql import Window

    want = df.withColumn("b", F.ntile(10).over(Window.orderBy("v", "id"))).groupBy("b").agg(F.count("*"), F.min("v"), F.max("v"), F.sum("y"))
    assert {tuple(r) for r in bins.ntile_buckets(df, "v", "y", ["id"]).collect()} == {tuple(r) for r in want.collect()}


def test_cohorts(spark):
    rows = [("Jan", 0, "u1", 5.0), ("Jan", 1, "u1", 5.0), ("Jan", 2, "u1", 10.0), ("Jan", 0, "u2", 10.0), ("Jan", 1, "u2", 10.0), ("Feb", 0, "u3", 1.0), ("Feb", 1, "u3", 1.0), ("Feb", 0, "u4", 1.0)]
    df = spark.createDataFrame(rows, "cohort string, offset int, user string, value double")
    m = cohort.retention_matrix(df, "user")
    got = {(r["cohort"], r["offset"]): r["rate"] for r in m.collect()}
    assert got == {("Jan", 0): 1, ("Jan", 1): 1, ("Jan", 2): 0.5, ("Feb", 0): 1, ("Feb", 1): 0.5}
    assert {r["offset"]: r["rate"] for r in cohort.overall_rate(m).collect()}[1] == 0.75
    assert [r["ltv"] for r in cohort.cohort_ltv(df, "user", "value").filter("cohort = 'Jan'").orderBy("offset").collect()] == [7.5, 15, 20]
    assert [r["cohort"] for r in cohort.vintage_compare(m, 1).collect()] == ["Jan", "Feb"]


def test_series(spark):
    s = spark.createDataFrame([(i, 2.0 * i + 2) for i in range(5)], "t int, y double")
    assert [(r["forecast"], r["low"]) for r in series.forecast(s, 2).orderBy("t").collect()] == [(pytest.approx(12), pytest.approx(12)), (pytest.approx(14), pytest.approx(14))]
    spiky = spark.createDataFrame([(i, float(i % 3) + (50 if i == 9 else 0)) for i in range(20)], "t int, y double")
    assert [r["t"] for r in series.anomalies(spiky).collect()] == [9]
    saw = spark.createDataFrame([(i, 10.0 if i % 2 else 0.0) for i in range(12)], "t int, y double")
    assert series.seasonality_strength(saw, 2).first()[0] > 0.95
    assert [r["forecast"] for r in series.forecast(saw, 2, 2).orderBy("t").collect()] == [pytest.approx(0, abs=2), pytest.approx(10, abs=2)]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(0.875)
    c = metrics.confusion(df, "y", "s").first()
    assert (c["tp"], c["fp"], c["tn"], c["fn"]) == (2, 1, 1, 0)
    assert metrics.roc_auc(df.filter("y = 1"), "y", "s").first()[0] is None
    assert metrics.ks_statistic(df, "y", "s").first()[0] == pytest.approx(0.5)


def churn(spark, n=4000):
    h = lambda k, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k))
    df = spark.range(n).select("id", h(31, "d").cast("int").alias("Payment Delay"), h(60, "t").cast("int").alias("Tenure"), F.when(h(2, "g") == 0, "Male").otherwise("Female").alias("Gender"), F.element_at(F.array(F.lit("Annual"), F.lit("Monthly"), F.lit("Quarterly")), (h(3, "c") + 1).cast("int")).alias("Contract Length"), (h(10000, "u") / 10000).alias("u"))
    p = F.when(F.col("Payment Delay") < 16, 0.10).when(F.col("Payment Delay") < 21, 0.58).otherwise(0.77)
    p = p + F.when(F.col("Contract Length") == "Monthly", 0.18).when(F.col("Contract Length") == "Annual", -0.15).otherwise(0.0)
    return df.withColumn("Churn", (F.col("u") < p).cast("int")).drop("u").withColumnRenamed("id", "CustomerID")


def test_threshold_in_data(spark):
    t = bins.find_threshold(churn(spark, 8000), "Payment Delay", "Churn", ["CustomerID"])
    assert t.recommend and t.cuts == (16.0, 21.0)


def test_logit_solves_its_equations_and_refuses_degenerate_data(spark):
    df = churn(spark)
    design = logit.build_design(df, ["Tenure"], ["Gender"], {"Payment Delay": [16, 21]})
    assert design.names == ("Tenure", "Gender=Male", "Payment Delay=16-20", "Payment Delay=21+")
    fit = logit.fit_logit(df, "Churn", design)
    scored = df.select("Churn", fit.score(design).alias("p"), *[c.alias(f"x{i}") for i, c in enumerate(design.columns)])
    row = scored.agg(F.sum(F.col("Churn") - F.col("p")), *[F.sum(F.col(f"x{i}") * (F.col("Churn") - F.col("p"))) for i in range(len(design.columns))]).first()
    assert all(abs(v) < 1e-5 for v in row)
    assert 0.1 < fit.mcfadden < 0.6 and fit.fingerprint() == logit.fit_logit(df.repartition(3), "Churn", design).fingerprint()
    with pytest.raises(logit.DegenerateFit, match="depend"):
        logit.fit_logit(df, "Churn", logit.build_design(df.withColumn("T2", F.col("Tenure") * 2), ["Tenure"], []) and logit.Design(("a", "b"), (F.col("Tenure").cast("double"), F.col("Tenure") * 2.0), ("continuous",) * 2))
    with pytest.raises(logit.DegenerateFit, match="one class"):
        logit.fit_logit(df.filter("Churn = 1"), "Churn", design)
    with pytest.raises(logit.DegenerateFit, match="separation"):
        logit.fit_logit(df, "Churn", logit.Design(("y",), (F.col("Churn").cast("double"),), ("continuous",)))
    with pytest.raises(ValueError):
        logit.build_design(df, ["Payment Delay"], [], {"Payment Delay": [16]})


def test_scores(spark):
    df = churn(spark, 1000)
    design = logit.build_design(df, ["Tenure"], [], {"Payment Delay": [16, 21]})
    fit = logit.fit_logit(df, "Churn", design)
    rows = logit.score_table(df, design, fit, "CustomerID", TierPolicy(), "Churn").collect()
    assert len(rows) == 1000 and all(r["tier"] == TierPolicy().of(r["score"]) and r["flagged"] == (r["score"] >= 0.5) for r in rows)
    assert rows[0]["factor_1"] and rows[0]["actual"] in (0, 1)


def test_split_is_stable(spark):
    df = churn(spark, 2000)
    a = logit.stratified_split(df, "Churn", "CustomerID", 0.25, 3)
    b = logit.stratified_split(df.repartition(13), "Churn", "CustomerID", 0.25, 3)
    ids = lambda d: {r[0] for r in d.filter("is_test").select("CustomerID").collect()}
    assert ids(a) == ids(b) and a.count() == 2000
    for r in a.groupBy("Churn").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r["t"] == math.floor(r["n"] * 0.25 + 0.5)


def test_tier_policy():
    p = TierPolicy()
    assert [p.of(x) for x in (0, 0.3999, 0.4, 0.7, 1.0)] == ["Low", "Low", "Medium", "High", "High"]
    assert "WHEN score < 0.4 THEN 'Low'" in p.sql() and p.digest() != TierPolicy(flag_threshold=0.6).digest()
    with pytest.raises(ValueError):
        TierPolicy((("a", 0.0, 0.5), ("b", 0.6, 1.01)))


def test_association(spark):
    df = churn(spark)
    rates = assoc.group_rates(df, "Gender", "Churn").collect()
    assert sum(r["n"] * r["rate"] for r in rates) / 4000 == pytest.approx(df.agg(F.avg("Churn")).first()[0])
    assert assoc.with_p_values(assoc.chi_square(df, "Gender", "Churn"))[0]["p_value"] > 0.01
    found = assoc.rank_findings(assoc.numeric_findings(df, ["Payment Delay", "Tenure"], "Churn") + assoc.categorical_findings(df, ["Gender"], "Churn"), 2)
    assert found[0]["column"] == "Payment Delay" and len(found) == 2
    constant = df.withColumn("c", F.lit(1.0))
    assert assoc.point_biserial(constant, ["c"], "Churn").first()["r"] is None


def test_profile_and_sanity(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", None), (2, "b", None)], "id int, s string, n string")
    p = profile.profile_table(df)
    assert p["duplicate_rows"] == 1 and p["columns"]["n"]["null_rate"] == 1 and profile.verdict(p) == "GO-WITH-CAVEATS"
    assert profile.verdict(profile.profile_table(df.limit(0))) == "NO-GO"
    assert sanity.duplicate_keys(df, ["id"]).first()["duplicate_keys"] == 1
    assert sanity.rank_deficiency(spark.range(20).select("id", (F.col("id") * 2).alias("b"), (F.col("id") ** 2).alias("c")), ["id", "b", "c"]) == 1
    assert sanity.duplicate_columns(df.withColumn("t", F.col("s")), ["s", "n", "t"]) == [("s", "t")]


@pytest.mark.parametrize("most", [5, 100, 10**6])
def test_exact_quantiles(spark, most):
    import statistics

    from provenant.functions.ranks import exact_quantiles

    data = {"a": [float((i * 7919) % 1009) for i in range(1000)], "b": [1.0] * 400 + [2.0] * 401, "c": [5.0], "d": [float(i // 300) for i in range(900)], "e": [1.0] * 50 + [3.0] * 50}
    long = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "name string, value double")
    assert exact_quantiles(long, 0.5, most) == {k: statistics.median(v) for k, v in data.items()}


@pytest.mark.parametrize("cuts", [1, 3, 64])
def test_running_sums(spark, cuts):
    from provenant.functions.ranks import running_sums

    df = spark.range(200).select((F.col("id") * 37 % 211).cast("double").alias("v"), (F.col("id") % 5 + 1).alias("n"))
    rows = sorted(running_sums(df, "v", ["n"], cuts).collect())
    so_far = 0
    for r in rows:
        assert (r["before_n"], r["total_n"]) == (so_far, sum(x["n"] for x in rows))
        so_far += r["n"]
    assert running_sums(df.limit(0), "v", ["n"], cuts).count() == 0
