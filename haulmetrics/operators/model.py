"""Training, comparing, saving and applying the route-efficiency models."""

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from haulmetrics.functions.scalars import clip
from haulmetrics.operators import features as feat
from haulmetrics.plans.staging import stage

ZONES, ZONE_STARTS = 50, 10
STARTS_AT_ONCE = 4
RIDGE_ALPHA = 1.0
SEED = 42
# Boosting rounds of the two models.
BOOSTING_ROUNDS = {"telemetry": 300, "trips": 200}
LEARNING_RATE, MIN_LEAF_ROWS = 0.05, 20
FIT_ROWS = 100_000  # training rows a task should have, where there are more tasks than cores
TREE_DEPTH = 5  # 32 leaves, next to the 31 of a leaf-wise tree
MODEL_VERSION = "spark_gbt_v1"
# One-hot encoded inputs.
CATEGORICAL = ["zone_start_id", "zone_end_id", "distance_bucket"]
ZONE_COLUMNS = {"zone_start_id": ["lat_start", "lon_start"], "zone_end_id": ["lat_end", "lon_end"]}
# Name patterns of the feature families.
FAMILIES = {
    "telemetry": "speed|stop|idle|overspeed|moving",
    "geo": "lat|lon|haversine|bearing|delta|zone",
    "time": "hour|dow",
}


def zone_starts(points: DataFrame, zone: str, k: int = ZONES, starts: int = ZONE_STARTS) -> list[KMeansModel]:
    """A model per seed from `SEED` on, a few at a time."""
    kmeans = KMeans(k=k, featuresCol=f"_{zone}_point", predictionCol=zone)
    fits = kmeans.fitMultiple(points, [{kmeans.seed: SEED + i} for i in range(starts)])
    with ThreadPool(STARTS_AT_ONCE) as pool:
        found = dict(pool.map(inheritable_thread_target(points.sparkSession)(lambda _: next(fits)), range(starts)))
    return [found[i] for i in range(starts)]


def fit_zones(train: DataFrame, k: int = ZONES, starts: int = ZONE_STARTS) -> PipelineModel:
    """Origin and destination zones, fit on training trips: of several starts the one of least cost, the first among equals."""
    points, stages = stage(train.select(*dict.fromkeys(c for columns in ZONE_COLUMNS.values() for c in columns)), "zone-points"), []
    for zone, columns in ZONE_COLUMNS.items():
        assembler = VectorAssembler(inputCols=columns, outputCol=f"_{zone}_point")
        models = zone_starts(assembler.transform(points), zone, k, starts)
        stages += [assembler, min(models, key=lambda m: m.summary.trainingCost)]
    return PipelineModel(stages=stages)


def apply_zones(df: DataFrame, zones: PipelineModel) -> DataFrame:
    return zones.transform(df).drop(*[f"_{z}_point" for z in ZONE_COLUMNS])


def fit_encoder(train: DataFrame, numeric: list[str]) -> PipelineModel:
    """One-hot levels seen in training (an unseen level is all zero) and the feature vector.

    The indexer keeps an extra slot for unseen levels, and the encoder drops that last slot.
    """
    indexed, hot = [f"_i_{c}" for c in CATEGORICAL], [f"_h_{c}" for c in CATEGORICAL]
    return Pipeline(stages=[
        StringIndexer(inputCols=CATEGORICAL, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=[*numeric, *hot], outputCol="features"),
    ]).fit(train)


def fit_ridge(train: DataFrame, alpha: float = RIDGE_ALPHA) -> PipelineModel:
    """Ridge on standardised inputs; Spark's penalty is per row, hence alpha / n."""
    return Pipeline(stages=[
        StandardScaler(withMean=True, inputCol="features", outputCol="scaled"),
        LinearRegression(featuresCol="scaled", labelCol=feat.TARGET, predictionCol="prediction",
                         regParam=alpha / train.count(), elasticNetParam=0.0, standardization=False),
    ]).fit(train)


def fit_trees(frame: DataFrame, rounds: int) -> PipelineModel:
    """Boosted trees on training rows, stopped early on the others."""
    trees = GBTRegressor(featuresCol="features", labelCol=feat.TARGET, predictionCol="prediction", maxIter=rounds,
                         stepSize=LEARNING_RATE, maxDepth=TREE_DEPTH, minInstancesPerNode=MIN_LEAF_ROWS,
                         subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED,
                         validationIndicatorCol="is_test", validationTol=0.001, checkpointInterval=10)
    return Pipeline(stages=[trees]).fit(frame.withColumn("is_test", ~F.col("is_train")))


def regression_metrics(predicted: DataFrame) -> DataFrame:
    """MAE, RMSE and R2 per split, from residuals."""
    y, e = F.col(feat.TARGET), F.col(feat.TARGET) - F.col("prediction")
    return (predicted.groupBy(F.when(F.col("is_train"), "train").otherwise("test").alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2")))


@dataclass
class Bundle:
    """Everything scoring needs."""

    zones: PipelineModel
    encoder: PipelineModel
    ridge: PipelineModel
    trees: PipelineModel
    vehicle_means: DataFrame
    metadata: DataFrame

    def save(self, folder: str) -> None:
        for name in ("zones", "encoder", "ridge", "trees"):
            getattr(self, name).save(f"{folder}/{name}")
        self.vehicle_means.write.parquet(f"{folder}/vehicle_means")
        self.metadata.write.parquet(f"{folder}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "Bundle":
        models = {n: PipelineModel.load(f"{folder}/{n}") for n in ("zones", "encoder", "ridge", "trees")}
        return cls(**models, vehicle_means=spark.read.parquet(f"{folder}/vehicle_means"),
                   metadata=spark.read.parquet(f"{folder}/metadata"))

    def vectors(self, df: DataFrame) -> DataFrame:
        """Zones, encodings and the feature vector of trips with engineered features."""
        meta = self.metadata.select("global_mean", "numeric_features").first()
        df = feat.encode_vehicle(apply_zones(df, self.zones), self.vehicle_means, F.lit(meta.global_mean))
        return self.encoder.transform(feat.fill_features(df, list(meta.numeric_features)))


def for_fitting(vectors: DataFrame, rows: int) -> DataFrame:
    """The same rows in no more partitions than rows or cores ask for. A boosting round runs a dozen stages, each of a task
    per partition that reports to the driver, so what it costs should follow from the rows and not from the shuffle settings."""
    return vectors.coalesce(max(vectors.sparkSession.sparkContext.defaultParallelism, -(-rows // FIT_ROWS)))


def train(frame: DataFrame, feature_set: str = "telemetry", rounds: int | None = None) -> tuple[Bundle, DataFrame]:
    """Fit on `is_train` rows; gives the bundle and both models' metrics per split.

    The trips-only model learns the bucket-speed target, the telemetry model the one the frame has.
    `frame` is read by every fit: pass a staged table.
    """
    spark = frame.sparkSession
    if feature_set == "trips":
        frame = feat.bucket_speed_frame(frame)
    numeric = [*feat.NUMERIC_FEATURES[feature_set], feat.ENCODED_VEHICLE]
    rows = frame.where("is_train")
    zones = fit_zones(rows)
    means = feat.vehicle_means(rows)
    facts = rows.agg(F.avg(feat.TARGET).alias("m"), F.count(F.lit(1)).alias("n")).first()
    with_levels = feat.fill_features(feat.encode_vehicle(apply_zones(frame, zones), means, F.lit(facts.m)), numeric)
    encoder = fit_encoder(with_levels.where("is_train"), numeric)
    vectors = for_fitting(encoder.transform(with_levels).select("trip_id", "is_train", feat.TARGET, "features"), facts.n)
    vectors.persist()
    try:
        ridge = fit_ridge(vectors.where("is_train"))
        trees = fit_trees(vectors, rounds or BOOSTING_ROUNDS[feature_set])
        scores = None
        for name, model in (("ridge", ridge), ("boosted_trees", trees)):
            one = regression_metrics(model.transform(vectors)).select(F.lit(name).alias("model"), "*")
            scores = one if scores is None else scores.unionByName(one)
        # Four rows: two models, two splits.
        scores = spark.createDataFrame(scores.collect(), scores.schema)
    finally:
        vectors.unpersist()
    test = scores.where((F.col("model") == "boosted_trees") & (F.col("split") == "test")).first()
    fitted = trees.stages[-1]
    metadata = spark.createDataFrame([(
        MODEL_VERSION, feature_set, float(facts.m), numeric, feat.EPSILON, feat.STOP_KMH, feat.OVERSPEED_KMH,
        int(facts.n), int(test.n) if test else 0, test.mae if test else None, test.rmse if test else None,
        test.r2 if test else None, int(fitted.numFeatures), int(fitted.getNumTrees))],
        "model_version string, feature_set string, global_mean double, numeric_features array<string>, epsilon double, "
        "stop_threshold_kmh double, overspeed_threshold_kmh double, train_size bigint, test_size bigint, "
        "test_mae double, test_rmse double, test_r2 double, feature_count bigint, best_iteration bigint")
    metadata = metadata.withColumn("training_timestamp", F.current_timestamp())
    return Bundle(zones, encoder, ridge, trees, means, metadata), scores


def compare_models(scores: DataFrame) -> DataFrame:
    """Both models side by side on test rows, the better one, and the gain in percent."""
    test = scores.where(F.col("split") == "test")

    def of(model: str, metric: str):
        return F.max(F.when(F.col("model") == model, F.col(metric)))

    out = test.agg(of("ridge", "mae").alias("ridge_mae"), of("boosted_trees", "mae").alias("trees_mae"),
                   of("ridge", "r2").alias("ridge_r2"), of("boosted_trees", "r2").alias("trees_r2"),
                   F.min_by("model", "mae").alias("best_by_mae"), F.max_by("model", "r2").alias("best_by_r2"))
    return (out.withColumn("mae_gain_percent", F.try_divide(F.col("ridge_mae") - F.col("trees_mae"), F.col("ridge_mae")) * 100)
            .withColumn("r2_gain_percent", F.try_divide(F.col("trees_r2") - F.col("ridge_r2"), 1 - F.col("ridge_r2")) * 100))


def feature_names(vectors: DataFrame) -> list[str]:
    """Slot names of the feature vector, from its schema."""
    attrs = vectors.schema["features"].metadata["ml_attr"]["attrs"]
    slots = sorted((a for kind in attrs.values() for a in kind), key=lambda a: a["idx"])
    return [a["name"].removeprefix("_h_") for a in slots]


def feature_importance(bundle: Bundle, names: list[str]) -> DataFrame:
    """Inputs of the boosted trees by importance, with their families."""
    spark = bundle.metadata.sparkSession
    weights = bundle.trees.stages[-1].featureImportances
    rows = [(name, float(weights[i])) for i, name in enumerate(names)]
    out = spark.createDataFrame(rows, "feature string, importance double")
    for family, pattern in FAMILIES.items():
        out = out.withColumn(f"is_{family}", F.col("feature").rlike(pattern))
    return out.orderBy(F.desc("importance"), "feature")


def predict(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Add the clipped prediction and model version to trips with engineered features."""
    version = bundle.metadata.select("model_version").first().model_version
    out = bundle.trees.transform(bundle.vectors(df))
    return (out.withColumn("predicted_route_efficiency", clip(F.col("prediction"), 0, 1))
            .withColumn("model_version", F.lit(version)))


def score_requests(requests: DataFrame, bundle: Bundle) -> DataFrame:
    """Predictions for valid requests; the others come back with the fields that failed."""
    checked = feat.validate_requests(feat.with_optional_fields(requests))
    good = predict(feat.scoring_features(checked.where(F.col("rejected_fields") == "")), bundle)
    bad = (checked.where(F.col("rejected_fields") != "")
           .withColumn("predicted_route_efficiency", F.lit(None).cast("double"))
           .withColumn("model_version", F.lit(None).cast("string")))
    columns = [*requests.columns, "rejected_fields", "predicted_route_efficiency", "model_version"]
    return good.select(*columns).unionByName(bad.select(*columns))
