"""A consensus score: a random forest over the results of several methods, calibrated by isotonic regression.

The forest learns from synthetic series; no real data are at hand, and no figures of other models are claimed for it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions import concordance, fits, spectra
from tidewheel.functions.columns import present
from tidewheel.operators.model import SERIES
from tidewheel.sources import synthetic

FEATURES = ["jtk_p", "jtk_tau", "cosinor_p", "cosinor_amplitude", "cosinor_r2", "ls_p", "ls_power", "f24", "period_agreement", "log_min_p", "dev_24h"]
#: Beside the model's features: the p-value of two harmonics, and the share of four methods with p under 0.05.
FURTHER = ["harmonic_p", "method_agreement"]
MISSING = -999.0


def period_range(low: float | None = None, high: float | None = None) -> tuple[float, float]:
    """A range of periods inside 18 to 32 hours; one that overlaps it by less than an hour gives way to 20 to 28."""
    lo, hi = max(18.0, low if low is not None else 20.0), min(32.0, high if high is not None else 28.0)
    return (lo, hi) if hi - lo >= 1 else (20.0, 28.0)


def features(t: np.ndarray, y: np.ndarray, low: float = 20.0, high: float = 28.0) -> dict[str, float]:
    """All methods on one series; what fails is missing."""
    t, y = spectra.averaged(t, y)
    out = dict.fromkeys([*FEATURES, *FURTHER], MISSING)
    if len(t) < 4 or np.ptp(y) == 0:
        return out
    found = []
    jtk = concordance.detect(t, y, periods=tuple(range(int(np.ceil(low)), int(high) + 1)))[0]
    out |= {"jtk_p": jtk["p_bh"], "jtk_tau": abs(jtk["tau"])}
    found.append(jtk["period"])
    grid = np.arange(low, high + 0.01, 0.5)
    best = fits.harmonic(t, y, grid, 1)
    out |= {"cosinor_p": min(1.0, best["p_value"] * len(grid)), "cosinor_amplitude": best["amplitudes"][0] / (y.std() or 1), "cosinor_r2": best["r2"]}
    found.append(best["period"])
    ls = spectra.lomb_scargle(t, y, low, high, 200)
    out |= {"ls_p": ls["p_value"], "ls_power": ls["power"]}
    found.append(ls["period"])
    out["f24"] = float(np.log10(spectra.fourier_score(t, y, permutations=100)["score"] + 1e-6))
    out["period_agreement"] = float(np.std(found))
    out["log_min_p"] = float(-np.log10(max(min(out["jtk_p"], out["cosinor_p"], out["ls_p"]), 1e-16)))
    out["dev_24h"] = float(abs(np.mean(found) - 24))
    if len(t) >= 6:
        out["harmonic_p"] = fits.harmonic(t, y, grid, 2)["p_value"]
    ps = [out[k] for k in ("jtk_p", "cosinor_p", "ls_p", "harmonic_p") if out[k] != MISSING and np.isfinite(out[k])]
    out["method_agreement"] = float(np.mean([p < 0.05 for p in ps])) if ps else MISSING
    return out


def with_features(long: DataFrame, keys: Sequence[str] = tuple(SERIES), low: float = 20.0, high: float = 28.0) -> DataFrame:
    """Keys and FEATURES of each series."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            f = features(pdf["time"].to_numpy(float), pdf["value"].to_numpy(float), low, high)
        except Exception:  # a series without features is scored as such
            f = dict.fromkeys([*FEATURES, *FURTHER], MISSING)
        return pd.DataFrame([[*key, *(float(v) if np.isfinite(v) else MISSING for v in f.values())]], columns=[*keys, *FEATURES, *FURTHER])

    rows = long.filter(present(F.col("time")) & present(F.col("value"))).select(*keys, "time", "value")
    schema = ", ".join([*(f"{k} {long.schema[k].dataType.simpleString()}" for k in keys), *(f"{f} double" for f in [*FEATURES, *FURTHER])])
    return rows.groupBy(*keys).applyInPandas(run, schema)


def train(spark: SparkSession, n: int = 1600, trees: int = 200, seed: int = 42) -> PipelineModel:
    """Forest and calibration: the forest on four fifths of the instances, with classes of equal weight, the isotonic curve on its scores of the rest."""
    rows = with_features(synthetic.instances(spark, n, seed), ["instance", "rhythmic"]).withColumn("label", F.col("rhythmic").cast("double"))
    share = F.avg("label").over(Window.partitionBy(F.lit(0)))  # of the instances, which are few
    rows = rows.withColumn("weight", F.when(F.col("label") > 0, 0.5 / share).otherwise(0.5 / (1 - share))).cache()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=10, minInstancesPerNode=5, seed=seed, weightCol="weight", rawPredictionCol="raw", probabilityCol="probability", predictionCol="vote")
    first = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows.filter("instance % 5 != 0"))
    scored = first.transform(rows.filter("instance % 5 = 0")).select("label", vector_to_array("probability")[1].alias("score"))
    curve = IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="consensus").fit(scored)
    rows.unpersist()
    return PipelineModel([*first.stages, curve])


def predict(long: DataFrame, model: PipelineModel, keys: Sequence[str] = tuple(SERIES), low: float | None = None, high: float | None = None) -> DataFrame:
    """(keys, consensus, verdict): rhythmic from 0.7, borderline from 0.3, else arrhythmic."""
    scored = with_features(long, keys, *period_range(low, high))
    for stage in model.stages[:-1]:
        scored = stage.transform(scored)
    out = model.stages[-1].transform(scored.withColumn("score", vector_to_array("probability")[1]))
    verdict = F.when(F.col("consensus") >= 0.7, "rhythmic").when(F.col("consensus") >= 0.3, "borderline").otherwise("arrhythmic")
    return out.select(*keys, *FEATURES, *FURTHER, "score", "consensus", (1 - F.col("consensus")).alias("p_value"), verdict.alias("verdict"))


def importances(model: PipelineModel) -> dict[str, float]:
    """The forest's importance of each feature; they add up to 1."""
    return dict(zip(FEATURES, map(float, model.stages[1].featureImportances.toArray()), strict=True))


def method_scores(scored: DataFrame, keys: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """(keys, method, score): how much each method speaks for a rhythm, from 0 to 1; 0 where it is missing."""
    known = lambda c, v: F.when(F.col(c) != MISSING, v).otherwise(0.0)
    unit = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
    f24 = F.pow(F.lit(10.0), F.col("f24")) / 5
    parts = {
        "jtk": known("jtk_p", unit(1 - F.col("jtk_p"))), "cosinor": known("cosinor_r2", unit(F.col("cosinor_r2"))), "lomb_scargle": known("ls_p", unit(1 - F.col("ls_p"))),
        "fourier_score": known("f24", unit(f24)), "harmonic": known("harmonic_p", unit(1 - F.col("harmonic_p"))), "agreement": known("method_agreement", unit(F.col("method_agreement"))),
    }
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("method"), v.cast("double").alias("score")) for n, v in parts.items()))).alias("_m")
    return scored.select(*keys, pairs).select(*keys, "_m.method", "_m.score")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
