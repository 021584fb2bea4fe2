"""Operators on small tables, and sources on small files."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import activity, aggregate, cosinor, methods, model, prep
from tidewheel.plans import api
from tidewheel.sources import expression, monitors, sinks, synthetic, tables
from tidewheel.streaming import activity as stream


@pytest.fixture(scope="module")
def long(spark):
    t = np.tile(np.arange(0, 48, 2.0), 3)
    rng = np.random.default_rng(0)
    make = lambda c, peak, a: pd.DataFrame({"variable": "v", "condition": c, "subject": np.repeat(["s1", "s2", "s3"], 24), "time": t, "value": 10 + a * np.cos(2 * np.pi * (t - peak) / 24) + rng.normal(0, 0.2, len(t))})
    few = pd.DataFrame({"variable": "w", "condition": "a", "subject": "s1", "time": [0.0, 1.0, 2.0], "value": [1.0, None, 2.0]})
    flat = pd.DataFrame({"variable": "flat", "condition": "a", "subject": "s1", "time": np.arange(10.0), "value": 4.0})
    return spark.createDataFrame(pd.concat([make("a", 3, 2), make("b", 9, 2.4), few, flat])).withColumn("value", F.when(~F.isnan("value"), F.col("value"))).cache()


def test_cosinor_recovers_the_truth(long):
    got = {(r.variable, r.condition): r for r in cosinor.cosinor(long).collect()}
    assert (got["v", "a"].mesor, got["v", "a"].amplitude, got["v", "a"].peak_hour) == pytest.approx((10, 2, 3), abs=0.15)
    assert got["v", "b"].p_value < 1e-10 and not got["w", "a"].success and got["flat", "a"].r2 is None
    best = cosinor.best_period(cosinor.cosinor(long.filter("variable = 'v'"), cosinor.grid(20, 28, 0.5)))
    assert all(abs(r.period - 24) <= 0.5 for r in best.collect())
    top = cosinor.predict(cosinor.cosinor(long), 24).filter("condition = 'a' and variable = 'v'").orderBy(F.desc("fitted")).first()
    assert top.time == 3.0 and top.fitted == pytest.approx(12, abs=0.2)
    diff = api.compare(long.filter("variable = 'v'"), "least_squares").first()
    assert diff.d_peak_hour == pytest.approx(6, abs=0.3) and diff.d_amplitude == pytest.approx(0.4, abs=0.15)


def test_partitions_do_not_matter(spark, long):
    few = cosinor.cosinor(long.coalesce(1)).orderBy("variable", "condition").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    many = cosinor.cosinor(long.repartition(7)).orderBy("variable", "condition").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r.amplitude for r in few if r.success] == pytest.approx([r.amplitude for r in many if r.success])


@pytest.mark.parametrize("name", sorted(methods.METHODS))
def test_methods_never_raise(long, name):
    got = api.analyze(long, name).collect()
    by = {(r.variable, r.condition): r for r in got}
    assert not by["w", "a"].success and "points" in by["w", "a"].message
    if "count" not in name:
        assert by["v", "a"].success


def test_robust_compare(long):
    r = api.compare(long.filter("variable = 'v'")).first()
    assert r.success and r.d_hours == pytest.approx(6, abs=0.3) and r.d_amplitude_differs and r.p_difference < 1e-9


@pytest.fixture(scope="module")
def herds(spark):
    """Two conditions of six subjects, of which the second peaks six hours later, with a covariate."""
    rng = np.random.default_rng(1)
    frames = []
    for c, peak, amplitude in (("a", 3, 2.0), ("b", 9, 2.0), ("c", 3, 2.0)):
        for k in range(6):
            t = np.arange(0, 72, 2.0)
            y = 10 + 2 * (k % 2) + rng.normal(0, 0.5) + amplitude * np.cos(2 * np.pi * (t - peak - rng.normal(0, 0.2)) / 24) + rng.normal(0, 0.3, len(t))
            frames.append(pd.DataFrame({"variable": "v", "condition": c, "subject": f"{c}{k}", "time": t, "value": y, "batch": "xy"[k % 2]}))
    return spark.createDataFrame(pd.concat(frames)).cache()


def test_populations(herds):
    got = {(r.condition_0, r.condition_1): r for r in api.compare(herds, "populations").collect()}
    ab, ac = got["a", "b"], got["a", "c"]
    assert ab.p_rhythm < 1e-4 and ab.d_peak_hour == pytest.approx(6, abs=0.5) and ac.p_rhythm > 0.01 and ac.p_mesor > 0.01 and (ab.n_0, ab.n_1) == (6, 6)
    # Hotelling's test from the subjects' coefficients
    fits = cosinor.cosinor(herds, [24.0], ["condition", "subject"]).toPandas()
    x, y = (fits[fits.condition == c][["beta_cos", "beta_sin"]].to_numpy() for c in "ab")
    s = (np.cov(x.T) * 5 + np.cov(y.T) * 5) / 10
    f = 9 / 20 * 3 * (y.mean(0) - x.mean(0)) @ np.linalg.inv(s) @ (y.mean(0) - x.mean(0))
    assert ab.p_rhythm == pytest.approx((1 + 2 * f / 9) ** -4.5, rel=1e-6)
    mean = {r.condition: r for r in methods.population(herds, harmonics=2).collect()}
    assert mean["a"].n_subjects == 6 and mean["a"].amplitude == pytest.approx(2, abs=0.3) and mean["b"].peak_hour == pytest.approx(9, abs=1)
    one = {r.condition: r for r in methods.population(herds, harmonics=1).collect()}
    old = {r.condition: r for r in cosinor.population(herds).collect()}
    assert all(one[c].amplitude == pytest.approx(old[c].amplitude, rel=1e-3) and one[c].mesor_se == pytest.approx(old[c].mesor_se) for c in one)


@pytest.mark.parametrize("how", ["damped", "damped_populations", "bootstrap"])
def test_comparisons_of_nonlinear_and_resampled_fits(herds, how):
    got = {(r.condition_0, r.condition_1): r for r in api.compare(herds, how).collect()}
    name = "peak_hour" if how == "bootstrap" else "acrophase"
    shift = 6 if how == "bootstrap" else -np.pi / 2  # a phase is minus the peak's angle in the damped model
    assert got["a", "b"].success and got["a", "b"][f"d_{name}"] == pytest.approx(shift, abs=0.4) and got["a", "b"][f"p_{name}"] < 1e-4 < got["a", "c"][f"p_{name}"]
    with pytest.raises(ValueError, match="unknown comparison"):
        api.compare(herds, "nothing")


def test_mixed_with_covariates(herds):
    got = {r.condition: r for r in api.analyze(herds, "mixed", covariates=["batch"]).collect()}
    assert got["a"].success and got["a"].covariates[0] == pytest.approx(2, abs=0.8) and got["a"].p_value < 1e-9
    plain = {r.condition: r for r in api.analyze(herds, "mixed", reml=False).collect()}
    assert plain["a"].group_variance > got["a"].group_variance and plain["a"].covariates == []


def test_specs():
    from tidewheel.plans import specs

    assert [specs.periods(x) for x in ("24", "24, 12,48", "23-25", "25-23", "x", None, "-3", "0")] == [[24], [24, 12, 48], [23, 24, 25], [24], [24], [24], [24], [24]]
    assert [specs.harmonics(x) for x in ("1", "1, 2,3", "0", "7", "a", "")] == [[1], [1, 2, 3], [1], [1], [1], [1]]


def test_cleaning(spark):
    rows = [("v", "a", None, float(i), 100.0 if i == 5 else None if i == 7 else float(i % 3)) for i in range(20)]
    df = spark.createDataFrame(rows, "variable string, condition string, subject string, time double, value double")
    value = lambda d: {r.time: r.value for r in d.collect()}
    assert value(prep.mask_iqr(df))[5.0] is None and value(prep.mask_z(df, 3))[5.0] is None
    steps = prep.Steps(outliers="iqr", detrend="linear", smooth="moving_average")
    cleaned = value(prep.clean(df, steps))
    assert cleaned[5.0] is None and cleaned[7.0] is None and len(cleaned) == 20
    assert value(prep.interpolate(df))[7.0] == pytest.approx((0 + 2) / 2)
    line = df.withColumn("value", 3 + 2 * F.col("time"))
    assert max(abs(v) for v in value(prep.detrend_linear(line)).values()) < 1e-9


def test_detrending_by_hours_and_new_nulls(spark):
    t = np.arange(0, 96, 2.0)
    v = 0.3 * t + np.cos(2 * np.pi * t / 24)
    df = spark.createDataFrame(pd.DataFrame({"variable": "v", "condition": "a", "subject": "s", "time": t, "value": v}))
    got = prep.clean(df, prep.Steps(detrend="moving_average", trend_hours=24)).orderBy("time").toPandas()
    rows = prep.clean(df, prep.Steps(detrend="moving_average", trend_rows=12)).orderBy("time").toPandas()
    assert got.value.to_numpy() == pytest.approx(pd.Series(v - pd.Series(v).rolling(12, center=True, min_periods=1).mean()).to_numpy())
    assert got.value.to_numpy()[6:-6] == pytest.approx(rows.value.to_numpy()[6:-6])
    spiked = df.withColumn("value", F.when(F.col("time") == 10, 999.0).otherwise(F.col("value")))
    assert prep.new_nulls(spiked, prep.mask_iqr(spiked)).first().n_removed == 1


def test_absent_genes_are_zeros(spark):
    rows = [("g1", "c1", 2.0, "ZT02", "d", "AR1"), ("g2", "c1", 1.0, "ZT02", "d", "AR1"), ("g1", "c2", 5.0, "ZT06", "d", "AR2")]
    got = {(r.gene, r.cell_id): r.value for r in expression.with_zeros(spark.createDataFrame(rows, "gene string, cell_id string, value double, timepoint string, date string, batch string")).collect()}
    assert got == {("g1", "c1"): 2.0, ("g2", "c1"): 1.0, ("g1", "c2"): 5.0, ("g2", "c2"): 0.0}


def test_wheel_range_and_summary(spark):
    rows = [("w", dt.datetime(2020, 1, 1) + dt.timedelta(minutes=6 * i), None if i == 3 else i) for i in range(480)]
    df = spark.createDataFrame(rows, "subject string, ts timestamp_ntz, activity long")
    s = monitors.wheel_summary(df).first()
    assert (s.samples, s.missing, s.total) == (480, 1, sum(range(480)) - 3) and s.days == pytest.approx(479 * 6 / 1440)
    some = monitors.wheel_activity(df, "c", start="2020-01-02 00:00:00", end="2020-01-02 11:59:00")
    assert some.count() == 24 and some.agg(F.sum("activity")).first()[0] == sum(range(240, 360))


def test_consensus_scores(spark, tmp_path):
    from tidewheel.operators import consensus

    model = consensus.train(spark, 120, 20)
    consensus.save(model, f"{tmp_path}/model")
    t = np.arange(0, 72, 2.0)
    rng = np.random.default_rng(0)
    make = lambda c, v: pd.DataFrame({"variable": "v", "condition": c, "time": t, "value": v})
    long = spark.createDataFrame(pd.concat([make("wave", 5 + np.cos(2 * np.pi * t / 24) + rng.normal(0, 0.1, 36)), make("noise", rng.normal(0, 1, 36)), make("flat", np.ones(36))]))
    got = {r.condition: r for r in consensus.predict(long, consensus.load(f"{tmp_path}/model")).collect()}
    again = {r.condition: r.consensus for r in consensus.predict(long, model).collect()}
    assert {k: r.consensus for k, r in got.items()} == again and got["wave"].consensus > got["noise"].consensus and got["wave"].p_value == 1 - got["wave"].consensus
    assert got["wave"].method_agreement == 1.0 and got["flat"].jtk_p == consensus.MISSING
    assert sum(consensus.importances(model).values()) == pytest.approx(1)
    scores = {(r.condition, r.method): r.score for r in consensus.method_scores(consensus.predict(long, model)).collect()}
    assert len(scores) == 18 and all(0 <= v <= 1 for v in scores.values()) and scores["wave", "jtk"] > 0.9 and scores["flat", "cosinor"] == 0


def test_adjustment_is_step_up(spark):
    p = [0.01, 0.04, 0.03, 0.005, None, 0.04]
    got = {r.i: r for r in aggregate.adjusted(spark.createDataFrame(list(enumerate(p)), "i int, p_value double")).collect()}
    assert [got[i].q_bh for i in (0, 1, 2, 3, 5)] == pytest.approx([0.025, 0.04, 0.04, 0.025, 0.04]) and got[4].q_bh is None
    assert got[3].q_bonferroni == pytest.approx(0.025)


def test_adjustment_of_many_tests_is_that_of_one_sort(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random(400), rng.random(200) ** 30, np.repeat([0.0, 1.0, 0.25, 1e-300], 20), [np.nan] * 3])
    fam = rng.integers(0, 3, len(p))
    rows = [(i, None if f == 2 else str(f), None if v != v else float(v)) for i, (f, v) in enumerate(zip(fam.tolist(), p.tolist(), strict=True))]
    df = spark.createDataFrame(rows, "i int, f string, p_value double")

    def want(index):
        index = [i for i in index if p[i] == p[i]]
        order = sorted(index, key=lambda i: p[i])
        q, low = {}, 1.0
        for rank in range(len(order), 0, -1):
            low = min(low, p[order[rank - 1]] * len(order) / rank)
            q[order[rank - 1]] = low
        for v in {p[i] for i in index}:  # equal tests share the value of the last of them
            tied = [i for i in index if p[i] == v]
            q |= dict.fromkeys(tied, min(q[i] for i in tied))
        return q

    got = {r.i: r.q_bh for r in aggregate.adjusted(df).collect()}
    assert len(got) == len(p) and {i: q for i, q in got.items() if q is not None} == pytest.approx(want(range(len(p))))
    got = {r.i: r.q_bh for r in aggregate.adjusted(df, family=["f"]).collect()}
    assert len(got) == len(p) and all(got[i] == pytest.approx(q) for k in range(3) for i, q in want(np.flatnonzero(fam == k).tolist()).items())
    plan = aggregate.adjusted(df)._jdf.queryExecution().executedPlan().toString()
    assert all("_c" not in x or "_p" not in x for x in plan.splitlines() if "SinglePartition" in x)


@pytest.mark.parametrize(("times", "step", "want"), [
    ([0, 3, 9, 12], 3, [(0, 0), (3, 3), (9, 9), (12, 12)]),  # 6 is as near to 3 as to 9: the earlier one, which is there already
    ([1, 4, 7], 3, [(1, 1), (4, 4), (7, 7)]),
    ([0.5, 1.5, 3.0], 1, [(0.5, 0.5), (1.5, 1.5), (3.0, 3.5)]),
    ([0, 1, 2, 20], 6, [(0, 0), (2, 6), (20, 12)]),
    ([5], 2, [(5, 5)]),
])
def test_nearest_times(spark, times, step, want):
    df = spark.createDataFrame([("a", float(t)) for t in times] + [("b", 100.0), ("b", None)], "k string, time double")
    got = aggregate.nearest_times(df, step, ["k"]).collect()
    t = np.array(times, float)
    targets = np.arange(t[0], t[-1] + step / 2, step)
    brute = {}
    for x in targets:
        brute.setdefault(float(t[np.argmin(np.abs(t - x))]), float(x))
    rows = sorted((r.time, r.target) for r in got if r.k == "a")
    assert [r[0] for r in rows] == sorted(brute) and {r[0]: r[1] for r in rows} == brute and [r[0] for r in rows] == [w[0] for w in want]
    assert [(r.time, r.target) for r in got if r.k == "b"] == [(100.0, 100.0)]


def test_cosinor_errors(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.random(20) * 50)
    y = 5 + 2 * np.cos(2 * np.pi * (t - 4) / 24) + rng.normal(0, 1, 20)
    df = spark.createDataFrame(pd.DataFrame({"variable": "v", "condition": "a", "subject": "s", "time": t, "value": y}))
    x = np.column_stack([np.ones(20), np.cos(2 * np.pi * t / 24), np.sin(2 * np.pi * t / 24)])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    cov = np.linalg.inv(x.T @ x) * ((y - x @ beta) ** 2).sum() / 17
    a = np.hypot(*beta[1:])
    grad = np.array([[0, beta[1] / a, beta[2] / a], [0, -beta[2] / a**2, beta[1] / a**2]])
    want = np.sqrt(np.diag(grad @ cov @ grad.T))
    r = cosinor.cosinor(df).first()
    assert (r.mesor_se, r.amplitude_se, r.acrophase_se) == pytest.approx((np.sqrt(cov[0, 0]), *want))
    assert r.amplitude_hi - r.amplitude_lo == pytest.approx(2 * 1.96 * want[0])
    from tidewheel.functions import stats

    assert (r.amplitude_p, r.acrophase_p) == pytest.approx([stats.t_two_sided(beta[i] / np.sqrt(cov[i, i]), 17) for i in (1, 2)])
    swapped = np.sqrt((beta[1] ** 2 * cov[2, 2] + beta[2] ** 2 * cov[1, 1] + 2 * beta[1] * beta[2] * cov[1, 2]) / a**2)
    assert cosinor.cosinor(df, semantics="reference").first().amplitude_se == pytest.approx(swapped)
    plan = cosinor.cosinor(df, cosinor.grid(18, 32, 0.1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1


def test_chi2_lines(spark):
    rng = np.random.default_rng(0)
    t = np.arange(0, 24 * 10, 0.5)
    rows = [("c", f"n{k}", float(x), float(v)) for k in range(12) for x, v in zip(t, rng.poisson(5, len(t)), strict=True)]
    rows += [("c", f"r{k}", float(x), float(v)) for k in range(3) for x, v in zip(t, rng.poisson(5 + 4 * np.cos(2 * np.pi * t / 24.5)), strict=True)]
    qp = activity.chi2_periodogram(spark.createDataFrame(rows, "condition string, subject string, time double, activity double"), [22.0, 24.0, 24.5, 26.0], 0.5)
    tested = activity.chi2_tested(qp, 0.001).collect()
    assert not any(r.rhythmic for r in tested if r.subject[0] == "n") and all(r.rhythmic for r in tested if r.subject[0] == "r" and r.period == 24.5)
    assert all(r.rhythmic == (r.p_value < 0.001) for r in tested)
    assert all(r.rhythmic for r in activity.chi2_tested(qp, 0.05, semantics="reference").collect())
    group = activity.group_periodogram(activity.chi2_tested(qp, 0.001)).filter("period = 24.5").first()
    assert (group.n_rhythmic, group.n_total, group.tau, group.tau_sem) == (3, 15, 24.5, 0.0) and group.qp_sem > 0


def test_days_alpha_rho(spark):
    rows = [("c", "s", d * 24.0 + h, 10.0 if 6 + d <= h < 12 + d else 0.0) for d in range(3) for h in range(24)]
    days = activity.days_alpha_rho(spark.createDataFrame(rows, "condition string, subject string, time double, activity double"))
    assert sorted((r.day, r.alpha_hours, r.onset, r.offset) for r in days.collect()) == [(1, 6.0, 6.0, 11.0), (2, 6.0, 7.0, 12.0), (3, 6.0, 8.0, 13.0)]
    s = activity.alpha_rho_summary(days).first()
    assert (s.n_days, s.alpha_sd, s.rho_mean) == (3, 0.0, 18.0) and s.onset_sd == pytest.approx(np.std([6, 7, 8]))


def test_roles():
    from pyspark.sql import types as T

    class Wide:
        columns = ["ZT", "Treatment", "animal", "expr", "name"]
        schema = T.StructType([T.StructField(c, T.StringType() if c in ("Treatment", "name", "animal") else T.DoubleType()) for c in columns])

    r = model.detect_roles(Wide)
    assert (r.time, r.condition, r.subject, r.variables) == ("ZT", "Treatment", "animal", ["expr"])


def test_activity(spark):
    rows = [("c", "s", float(h), 0 if 30 <= h < 37 else 5 + h % 24) for h in range(96)]
    df = spark.createDataFrame(rows, "condition string, subject string, time double, activity long")
    assert activity.dead_channels(df).first().dead_from == 30.0 and activity.dead_channels(df, 8).count() == 0 and activity.alive(df).count() == 0
    assert activity.actogram(df).filter("day = 1").count() == 48 and activity.actogram(df).agg(F.max("day")).first()[0] == 3
    best = activity.best_chi2(activity.chi2_periodogram(df, cosinor.grid(18, 32, 1), 1.0)).first()
    assert best.period == 24
    r = activity.is_iv(df).first()
    assert 0.7 < r.interdaily_stability <= 1 and r.intradaily_variability < 1
    assert all(t.count() > 0 for t in api.activity_profile(df, (24.0,), 1.0).values())


def test_beam_files(spark, tmp_path):
    counts = "\t".join(["3"] * 31 + ["0"])
    lines = [f"{i}\t{1 + i // 48} Feb 24\t{i % 48 // 2:02d}:{i % 2 * 30:02d}:00\t1\t0\t0\t0\t0\t0\t0\t{counts}".replace("\t0\t0\t0\t0\t0\t0\t", "\t0\t0\t0\t0\t0\t") for i in range(96)]
    (tmp_path / "Monitor7.txt").write_text("\n".join([*lines, "broken line", "1\tx y z\tbad"]))
    rows = monitors.read_beams(spark, f"{tmp_path}/Monitor7.txt")
    assert rows.select("monitor").distinct().first()[0] == "7" and rows.count() == 96 * 32
    got = monitors.beam_activity(rows, "wt", 60.0)
    assert got.agg(F.count_distinct("subject")).first()[0] == 31 and got.filter("subject = 'M7_ch01'").agg(F.sum("activity")).first()[0] == 96 * 3
    assert got.agg(F.min("time")).first()[0] == -8.0
    known = monitors.beam_activity(rows, "wt", 60.0, corrected=False, dead_hours=None)
    assert known.agg(F.min("time"), F.max("time")).first() == (0.0, 47.0)
    assert monitors.beam_summary(rows).first().channels == 32


def test_wheel_files(spark, tmp_path):
    (tmp_path / "a.AWD").write_text("mouse1\n03-Jan-2020\n13:30\n 4 \n00\nmouse1\nX\n1\n2\n-1\nzz\n5\n")
    got = monitors.read_wheels(spark, f"{tmp_path}/a.AWD").orderBy("ts").collect()
    assert [r.activity for r in got] == [1, 2, None, None, 5] and got[0].ts == dt.datetime(2020, 1, 3, 13, 30) and got[4].ts == dt.datetime(2020, 1, 3, 13, 54)
    assert monitors.wheel_activity(monitors.read_wheels(spark, f"{tmp_path}/a.AWD"), "x", 6.0).count() == 5


def test_tables_and_sinks(spark, tmp_path):
    (tmp_path / "w.csv").write_text("time;condition;subject;act\n0;a;1;2.5\n2;a;1;NA\n")
    long = tables.auto_long(tables.read_csv(spark, f"{tmp_path}/w.csv"))
    assert [(r.variable, r.value) for r in long.orderBy("time").collect()] == [("act", 2.5), ("act", None)]
    with pytest.raises(ValueError, match="nope"):
        tables.read_long(spark, f"{tmp_path}/w.csv", "time", "condition", ["nope"])
    nested = spark.sql("select 1 as a, named_struct('x', 2, 'y', array(1,2)) as s, sequence(1, 9) as many")
    r = sinks.flat(nested).first()
    assert r.asDict() == {"a": 1, "s_x": 2, "s_y": "[1,2]", "many": "[9 items]"}
    sinks.export(nested, f"{tmp_path}/out.tsv")
    assert spark.read.csv(f"{tmp_path}/out.tsv", header=True, sep="\t").count() == 1
    with pytest.raises(ValueError, match="doc"):
        sinks.export(nested, "x.doc")


def test_expression_sources(spark, tmp_path):
    (tmp_path / "GSM12_ZT02_20190101_AR05.csv").write_text('"","c1","c2"\n"per","1","3"\n"tim","4","0"\n')
    got = expression.cell_counts(spark, f"{tmp_path}/GSM*.csv")
    assert {(r.gene, r.cell_id, r.value, r.timepoint, r.batch) for r in got.collect()} == {("per", "c1", 1, "ZT02", "AR05"), ("per", "c2", 3, "ZT02", "AR05"), ("tim", "c1", 4, "ZT02", "AR05"), ("tim", "c2", 0, "ZT02", "AR05")}
    assert aggregate.per_ten_thousand(got).filter("gene = 'per' and cell_id = 'c1'").first().tp10k == 2000
    (tmp_path / "m.txt").write_text('!Series_title\t"t"\n!Sample_title\t"ZT4 liver"\t"18 h"\n!series_matrix_table_begin\n"ID_REF"\t"S1"\t"S2"\n"p1"\t1.5\tnull\n!series_matrix_table_end\n')
    meta, values = expression.series_matrix(spark, f"{tmp_path}/m.txt")
    assert {(r.probe, r.sample, r.value) for r in values.collect()} == {("p1", "S1", 1.5), ("p1", "S2", None)}
    assert sorted(meta.filter("field = 'Sample_title'").select(expression.sample_hours(F.col("text"))).toPandas().iloc[:, 0]) == [4.0, 18.0]
    (tmp_path / "p.annot").write_text("^x\n#ID = y\nID\tGene symbol\np1\tPer1///Per2\np2\t\n")
    assert [tuple(r) for r in expression.probe_symbols(spark, f"{tmp_path}/p.annot").collect()] == [("p1", "Per1")]
    sheet = spark.createDataFrame([("a", 0.001, 24.0), ("b", 0.5, 24.0), ("c", 0.1, 24.0), ("d", None, 1.0)], "g string, q double, p double")
    assert [r.label for r in expression.label_sets(sheet, "q", "p").collect()] == ["R", "N", "ambiguous", None]


def test_synthetic_is_the_same_on_any_split(spark):
    a, b = (synthetic.instances(spark.newSession() if i else spark, 12).toPandas().sort_values(["instance", "time", "value"]).value.to_numpy() for i in (0, 1))
    assert (a == b).all()


def test_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("c", "s", t0 + dt.timedelta(minutes=10 * i), 1.0) for i in range(100)], stream.SCHEMA)
    df.write.parquet(f"{tmp_path}/in")
    stream.write(stream.binned(stream.read(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert {r.activity for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {3.0}


def test_consensus_separates(spark):
    from tidewheel.operators import consensus

    fresh = synthetic.instances(spark, 60, seed=7)
    got = consensus.predict(fresh, consensus.train(spark, 240, 40), ["instance", "rhythmic"]).toPandas()
    assert got[got.rhythmic].consensus.mean() > got[~got.rhythmic].consensus.mean() + 0.3
    assert consensus.period_range(30, 40) == (30, 32) and consensus.period_range(31.5, 40) == (20, 28)
