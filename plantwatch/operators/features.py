"""Feature table for failure models, and the models on Spark ML."""

from pyspark.sql import functions as F

from plantwatch.operators.ordered import chunk_window, with_neighbours, without_copies
from plantwatch.rules import REQUIRED_SENSORS

ROLLED = ["temperature", "vibration", "pressure", "power_consumption", "cycle_efficiency"]
SHORT, LONG, AHEAD = 7, 14, 5


def rolling_features(df, width=None, max_rows=1_000_000, label=False):
    """Per event: 7- and 14-row means and their difference, degradation speed and slope, recent anomalies.

    A frame covers the event and the ones before it on the same machine. ``label`` adds 1 when an anomaly occurs in
    the machine's next five events, else 0; its last event has none.
    """
    rows = df.select("machine_id", "machine_type", "timestamp", "event_id", *ROLLED, "degradation_level",
                     F.col("anomaly_detected").cast("int").alias("anomaly_detected_numeric"))
    rows = with_neighbours(rows, before=LONG - 1, after=AHEAD if label else 0, width=width, max_rows=max_rows)
    w = chunk_window()
    short, long = w.rowsBetween(-(SHORT - 1), 0), w.rowsBetween(-(LONG - 1), 0)
    rows = rows.withColumn("_n", F.row_number().over(w).cast("double"))
    features = {}
    for name in ROLLED:
        features[f"{name}_roll_{SHORT}"] = F.avg(name).over(short)
        features[f"{name}_roll_{LONG}"] = F.avg(name).over(long)
        features[f"{name}_trend"] = F.avg(name).over(short) - F.avg(name).over(long)
    features["degradation_velocity"] = F.col("degradation_level") - F.lag("degradation_level").over(w)
    features["degradation_slope"] = F.regr_slope("degradation_level", "_n").over(short)
    features["recent_anomaly_count"] = F.sum("anomaly_detected_numeric").over(long)
    features["anomaly_frequency"] = F.avg("anomaly_detected_numeric").over(long)
    if label:
        features["label"] = F.max("anomaly_detected_numeric").over(w.rowsBetween(1, AHEAD))
    return without_copies(rows.withColumns(features)).drop("_n")


def feature_names():
    rolled = [f"{n}{s}" for n in ROLLED for s in ("", f"_roll_{SHORT}", f"_roll_{LONG}", "_trend")]
    return rolled + ["degradation_level", "degradation_velocity", "degradation_slope", "anomaly_detected_numeric",
                     "recent_anomaly_count", "anomaly_frequency"] + [f"machine_type_{t}" for t in sorted(REQUIRED_SENSORS)]


def feature_table(df, width=None, max_rows=1_000_000):
    """34 features and the label per event. A sensor a machine lacks is 0; types are one column each."""
    numeric = feature_names()[:-len(REQUIRED_SENSORS)]
    types = [(F.col("machine_type") == t).cast("double").alias(f"machine_type_{t}") for t in sorted(REQUIRED_SENSORS)]
    return rolling_features(df, width, max_rows, label=True).filter("label IS NOT NULL").select(
        "machine_id", "timestamp", "event_id",
        *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in numeric], *types, "label")


def _assembled(table):
    from pyspark.ml.feature import VectorAssembler
    rows = VectorAssembler(inputCols=feature_names(), outputCol="features").transform(table)
    return rows.select("event_id", "features", F.col("label").cast("double").alias("label"))


def split(table, holdout_tenths=2):
    """Training and test rows by a hash of the machine: the same split on every run.

    Frames reach 13 rows back and labels 5 rows ahead on the same machine, so no test row shares rows with training.
    """
    part = F.pmod(F.xxhash64("machine_id"), F.lit(10))
    return table.filter(part >= holdout_tenths), table.filter(part < holdout_tenths)


def classifiers():
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    return {
        "Logistic Regression": LogisticRegression(maxIter=20),
        "Random Forest": RandomForestClassifier(numTrees=20, maxDepth=5, seed=42),
        "Gradient Boosted Trees": GBTClassifier(maxIter=10, maxDepth=4, seed=42),
    }


def _scores(predictions):
    """Accuracy, precision, recall and F1 from one aggregate."""
    hit = lambda label, guess: F.count_if((F.col("label") == label) & (F.col("prediction") == guess))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    counts = predictions.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def compare_classifiers(table, models=None):
    """Five measures per model: one row each. Pass a stored table: training reads it many times."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    train, test = split(table)
    train, test = _assembled(train), _assembled(test)
    area = BinaryClassificationEvaluator(metricName="areaUnderROC")
    result = None
    for name, estimator in (models or classifiers()).items():
        predictions = estimator.fit(train).transform(test)
        row = _scores(predictions).select(F.lit(name).alias("model"), "*", F.lit(area.evaluate(predictions)).alias("roc_auc"))
        result = row if result is None else result.unionByName(row)
    return result


def feature_importances(table):
    """Importance of each feature in a random forest, largest first."""
    model = classifiers()["Random Forest"].fit(_assembled(split(table)[0]))
    pairs = list(zip(feature_names(), [float(v) for v in model.featureImportances.toArray()]))
    return table.sparkSession.createDataFrame(pairs, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")
