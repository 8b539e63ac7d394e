"""Class-weighted models of injury risk on Spark ML.

Training is distributed over the rows; what comes back to the driver is a model
of bounded size and a few metrics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import (
    PCA,
    Imputer,
    OneHotEncoder,
    OneHotEncoderModel,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from fieldpulse.operators.features import ranked_share, stratified_folds, with_class_weight
from fieldpulse.session import ensure_checkpoint_dir
from fieldpulse.sources.literals import literal_table

# Settings of the boosted trees.
MAX_DEPTH = 3
LEARNING_RATE = 0.1
TREES = 100
ROW_SHARE = 0.8
COLUMN_SHARE = 0.8

# Models trained at the same time when folds are compared.
TRAININGS_AT_ONCE = 8
# Rows of features in a partition while models are compared.
PARTITION_ROWS = 200_000


def feature_stages(numeric: Sequence[str], categorical: Sequence[str] = ()) -> list:
    """Scaled numbers, and one-hot categories if any, as one ``features`` vector.

    A missing number, null or NaN, stands for the mean of its column, which scales to 0.
    """
    filled = [f"_{c}_filled" for c in numeric]
    stages: list = [
        Imputer(inputCols=list(numeric), outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol="_numbers"),
        StandardScaler(
            inputCol="_numbers",
            outputCol="_scaled" if categorical else "features",
            withMean=True,
            withStd=True,
        ),
    ]
    if categorical:
        indexed = [f"_{c}_index" for c in categorical]
        encoded = [f"_{c}_vector" for c in categorical]
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep"),
            VectorAssembler(inputCols=["_scaled", *encoded], outputCol="features"),
        ]
    return stages


def boosted_trees(label: str, trees: int = TREES, seed: int = 94) -> GBTClassifier:
    return GBTClassifier(
        labelCol=label,
        featuresCol="features",
        weightCol="weight",
        maxDepth=MAX_DEPTH,
        stepSize=LEARNING_RATE,
        maxIter=trees,
        subsamplingRate=ROW_SHARE,
        featureSubsetStrategy=str(COLUMN_SHARE),
        seed=seed,
    )


def train(
    df: DataFrame,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    trees: int = TREES,
    seed: int = 94,
) -> PipelineModel:
    """Boosted trees on rows weighted so that both classes count the same."""
    ensure_checkpoint_dir(df.sparkSession)
    weighted = with_class_weight(df, label)
    stages = feature_stages(numeric, categorical) + [boosted_trees(label, trees, seed)]
    return Pipeline(stages=stages).fit(weighted)


def importances(
    model: PipelineModel, numeric: Sequence[str], spark, categorical: Sequence[str] = ()
) -> DataFrame:
    """All features by importance, largest first; a category has the sum over its values."""
    values = model.stages[-1].featureImportances.toArray()
    names = list(numeric)
    for stage in model.stages:
        if isinstance(stage, OneHotEncoderModel):
            for name, size in zip(categorical, stage.categorySizes):
                names += [name] * size
    if len(names) != len(values):
        raise ValueError(f"{len(values)} importances for {len(names)} slots of features")
    totals = dict.fromkeys([*numeric, *categorical], 0.0)
    for name, value in zip(names, values):
        totals[name] += float(value)
    rows = sorted(totals.items(), key=lambda r: -r[1])
    return literal_table(spark, rows, _pair("feature", "string", "importance", "double"))


def _pair(*names_and_types: str):
    types = {
        "string": StringType(), "double": DoubleType(), "int": IntegerType(), "bigint": LongType(),
    }
    schema = StructType()
    for name, kind in zip(names_and_types[::2], names_and_types[1::2]):
        schema = schema.add(name, types[kind])
    return schema


def area_under_roc(scored: DataFrame, label: str) -> float:
    """Over every distinct score, not over bins of scores."""
    return BinaryClassificationEvaluator(
        labelCol=label, metricName="areaUnderROC", numBins=0
    ).evaluate(scored)


def average_precision(scored: DataFrame, label: str) -> float:
    """Area under the precision-recall curve."""
    return BinaryClassificationEvaluator(
        labelCol=label, metricName="areaUnderPR", numBins=0
    ).evaluate(scored)


def classification_report(
    scored: DataFrame, label: str, prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class, from the table of label by prediction."""
    cells = scored.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.lit("actual").alias("side")),
                F.struct(F.col("predicted").alias("class"), F.lit("predicted").alias("side")),
            )
        ).alias("s"),
        "n",
        (F.col("label") == F.col("predicted")).alias("hit"),
    )
    hits = F.sum(F.when((F.col("s.side") == "actual") & F.col("hit"), F.col("n")).otherwise(0))
    actual = F.sum(F.when(F.col("s.side") == "actual", F.col("n")).otherwise(0))
    predicted = F.sum(F.when(F.col("s.side") == "predicted", F.col("n")).otherwise(0))
    counted = sides.groupBy(F.col("s.class").alias("class")).agg(
        hits.alias("hits"), actual.alias("support"), predicted.alias("predicted")
    )
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return counted.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        "support",
    )


def evaluate(scored: DataFrame, label: str) -> DataFrame:
    rows = [
        ("area_under_roc", area_under_roc(scored, label)),
        ("average_precision", average_precision(scored, label)),
    ]
    return literal_table(scored.sparkSession, rows, _pair("metric", "string", "value", "double"))


def cross_validated_auc(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    numeric: Sequence[str],
    folds: int = 5,
    trees: int = TREES,
    seed: int = 94,
) -> DataFrame:
    """AUC on each stratified fold, with the mean and two standard deviations."""
    kept = _kept(df, label, key, numeric)
    try:
        folded = stratified_folds(kept, label, key, folds, seed).withColumn("_part", F.lit(0.0))
        found = _scores(folded, label, numeric, [0.0], folds, trees, seed)
    finally:
        kept.unpersist()
    scores = [(i, test) for i, (_, _, test) in enumerate(found)]
    table = literal_table(df.sparkSession, scores, _pair("fold", "int", "auc", "double"))
    summary = table.agg(F.mean("auc").alias("mean_auc"), (2 * F.stddev_pop("auc")).alias("two_sigma"))
    mean, spread = summary.select("mean_auc").scalar(), summary.select("two_sigma").scalar()
    return table.withColumns({"mean_auc": mean, "two_sigma": spread})


def _kept(df: DataFrame, label: str, key: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """The columns that models need, kept, since ranks, fits and counts each read them again."""
    return df.select(*dict.fromkeys([label, *key, *numeric])).persist()


def _scores(
    folded: DataFrame, label: str, numeric: Sequence[str], shares: Sequence[float], folds: int, trees: int, seed: int
) -> list[tuple[int, float, float]]:
    """(training rows, AUC on them, AUC on the fold) for each share and fold, shares first.

    ``folded`` has ``fold`` and ``_part``. Features are made once for all models and kept as
    vectors with their folds and shares; a model takes its rows from there. Scaling is the same
    for all and the trees split alike whatever the scale, so only the value for missing
    numbers, a mean over all rows, is shared knowledge.
    """
    spark = folded.sparkSession
    ensure_checkpoint_dir(spark)
    stages = Pipeline(stages=feature_stages(numeric)).fit(folded)
    made = stages.transform(folded).select(label, "features", "fold", "_part")
    # Enough rows in a partition to be worth a task: each model is many small jobs.
    n_rows = folded.count()
    ready = made.coalesce(max(1, -(-n_rows // PARTITION_ROWS))).persist()
    try:
        counted = ready.groupBy("_part", "fold", F.col(label).cast("int").alias("class")).count()
        cells = counted.groupBy("fold", "class", _step(shares).alias("share")).agg(F.sum("count").alias("n")).collect()

        def of(run: tuple[int, int]) -> tuple[int, float, float]:
            share, fold = run
            own = [c for c in cells if c["share"] is not None and c["share"] <= share and c["fold"] != fold]
            ones = sum(c["n"] for c in own if c["class"] == 1)
            zeros = sum(c["n"] for c in own if c["class"] == 0)
            weight = F.when(F.col(label) == 1, F.lit(zeros / ones if ones else 1.0)).otherwise(F.lit(1.0))
            training = ready.filter((F.col("_part") <= shares[share]) & (F.col("fold") != fold))
            model = boosted_trees(label, trees, seed).fit(training.withColumn("weight", weight))
            held_out = ready.filter(F.col("fold") == fold)
            return (
                ones + zeros,
                area_under_roc(model.transform(training), label),
                area_under_roc(model.transform(held_out), label),
            )

        return _side_by_side(of, [(n, i) for n in range(len(shares)) for i in range(folds)])
    finally:
        ready.unpersist()


def _step(shares: Sequence[float]):
    """Number of the first share that holds a row."""
    chosen = F.lit(None).cast("int")
    for n, share in reversed(list(enumerate(shares))):
        chosen = F.when(F.col("_part") <= share, F.lit(n)).otherwise(chosen)
    return chosen


def _side_by_side(run: Callable, over: Iterable) -> list:
    """Results in order; several trainings are submitted at once, since each is many small jobs."""
    with ThreadPoolExecutor(TRAININGS_AT_ONCE) as pool:
        return list(pool.map(run, over))


def learning_curve(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    numeric: Sequence[str],
    shares: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0),
    folds: int = 5,
    trees: int = TREES,
    seed: int = 94,
) -> DataFrame:
    """Training and held-out AUC for growing, nested shares of the training rows.

    A share is a range of the random rank within each class, so every share holds
    both classes in proportion and contains the smaller ones. ``rows`` is what the first
    fold's model is trained on.
    """
    kept = _kept(df, label, key, numeric)
    try:
        folded = ranked_share(kept, label, key, seed).withColumns(
            {
                "fold": (F.col("_rank") % folds).cast("int"),
                "_part": (F.col("_rank") + 1) / F.col("_size"),
            }
        )
        found = _scores(folded, label, numeric, shares, folds, trees, seed)
    finally:
        kept.unpersist()
    rows = []
    for n, share in enumerate(shares):
        own = found[n * folds : (n + 1) * folds]
        train, test = (sum(s[k] for s in own) / folds for k in (1, 2))
        rows.append((float(share), own[0][0], train, test))
    schema = _pair("share", "double", "rows", "bigint", "train_auc", "double", "test_auc", "double")
    return literal_table(df.sparkSession, rows, schema)


def principal_components(
    df: DataFrame, numeric: Sequence[str], components: int = 3
) -> tuple[PipelineModel, DataFrame]:
    """Scaled features on their leading components; the model and the explained shares."""
    stages = feature_stages(numeric) + [PCA(k=components, inputCol="features", outputCol="components")]
    model = Pipeline(stages=stages).fit(df)
    shares = [(i + 1, float(v)) for i, v in enumerate(model.stages[-1].explainedVariance)]
    schema = _pair("component", "int", "explained", "double")
    return model, literal_table(df.sparkSession, shares, schema)


def kmeans_elbow(
    df: DataFrame, features: str = "components", ks: Sequence[int] = tuple(range(2, 9)), seed: int = 94
) -> DataFrame:
    """Within-cluster cost and silhouette per number of clusters."""
    vectors = df.select(features).persist()
    try:
        rows = []
        for k in ks:
            model = KMeans(k=k, featuresCol=features, seed=seed).fit(vectors)
            silhouette = ClusteringEvaluator(featuresCol=features).evaluate(model.transform(vectors))
            rows.append((k, float(model.summary.trainingCost), float(silhouette)))
    finally:
        vectors.unpersist()
    schema = _pair("k", "int", "cost", "double", "silhouette", "double")
    return literal_table(df.sparkSession, rows, schema)


def forest_importances(
    df: DataFrame, label: str, numeric: Sequence[str], trees: int = TREES, seed: int = 94
) -> DataFrame:
    """Feature importances of a class-weighted random forest."""
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, seed=seed
    )
    stages = feature_stages(numeric) + [forest]
    model = Pipeline(stages=stages).fit(with_class_weight(df, label))
    return importances(model, numeric, df.sparkSession)


def probability_of(scored: DataFrame, out: str = "score") -> DataFrame:
    """Probability of the positive class as a plain number."""
    return scored.withColumn(out, vector_to_array("probability")[1])
