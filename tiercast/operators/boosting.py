"""Boosted trees with Spark ML: fits, out-of-fold scores, model files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tiercast.config import PanelConfig
from tiercast.functions.vectors import is_dense, ml_vector
from tiercast.operators.matrix import feature_table, logged_array
from tiercast.operators.population import KEYS
from tiercast.sources.storage import fresh_path, shared_folder


#: Tasks of a fit. Every tree level is a job over all of them whose shuffle has a block for each pair of
#: tasks, so that their number must not go with the rows.
MAX_TASKS = 64

#: Bytes of binned rows that fits running at once may hold where one alone keeps the cores busy. Spark ML keeps
#: a row as 4 bytes a feature and some 60 more while it fits; what memory does not hold is read from disk again for every tree level.
HELD_AT_ONCE = 2**30


def model_rows(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """The matrix with its feature columns packed into ``x``, on the log1p scale."""
    wanted = set(names)
    kept = [c for c in matrix.columns if c not in wanted]
    return matrix.select(*kept, logged_array(names).alias("x"))


def tasks_of(n_rows: int, cfg: PanelConfig) -> int:
    return min(max(1, n_rows // cfg.fit_rows_per_task), MAX_TASKS)


def fits_at_once(n_rows: int, n_features: int, cores: int, cfg: PanelConfig) -> int:
    """How many fits of so many rows run side by side: enough for all cores, more where they take little room, ``parallel_fits`` at most."""
    small_enough = HELD_AT_ONCE // max(1, n_rows * (4 * n_features + 60))
    return max(1, min(cfg.parallel_fits, max(-(-cores // tasks_of(n_rows, cfg)), small_enough)))


def _laid_out(rows: DataFrame, parts: int, pos_weight: float, *kept: str) -> DataFrame:
    """``rows`` as Spark ML takes them, in ``parts`` tasks by key, and kept on disk.

    Spark ML goes over its input three times before it has its own form of it; memory is for that form.
    """
    return (
        rows.repartition(parts, *KEYS)
        .sortWithinPartitions(*KEYS)
        .select(
            *kept,
            ml_vector(rows).alias("features"),
            F.col("engaged").cast("double").alias("label"),
            F.when(F.col("engaged") == 1, F.lit(float(pos_weight))).otherwise(1.0).alias("weight"),
        )
        .persist(StorageLevel.DISK_ONLY)
    )


def _fitted(data: DataFrame, cfg: PanelConfig) -> GBTClassificationModel:
    shared_folder(data.sparkSession)  # boosting cuts its lineage in the checkpoint folder
    m = cfg.model
    return GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight",
        maxIter=m.trees, maxDepth=m.depth, stepSize=m.learning_rate,
        subsamplingRate=m.row_share, featureSubsetStrategy=str(m.feature_share),
        minInstancesPerNode=m.min_rows_per_leaf, seed=cfg.seed,
    ).fit(data)


def fit(rows: DataFrame, pos_weight: float, cfg: PanelConfig) -> GBTClassificationModel:
    """One weighted fit on ``rows`` (KEYS, engaged, x); dense and sparse vectors give the same model.

    Rows are laid out by key first, in a task for every ``fit_rows_per_task``
    rows but no more than ``MAX_TASKS``; beyond that a task holds more rows. The row sampling goes by partition and position, so the model depends
    on the rows and the configuration alone, never on a session setting.
    """
    data = _laid_out(rows, tasks_of(rows.count(), cfg), pos_weight)
    try:
        return _fitted(data, cfg)
    finally:
        data.unpersist()


def score(rows: DataFrame, model: GBTClassificationModel, name: str = "score") -> DataFrame:
    """Add the probability of the positive class."""
    scored = model.transform(rows.withColumn("features", ml_vector(rows)))
    return scored.withColumn(name, F.element_at(vector_to_array("probability"), 2)).select(
        *rows.columns, name
    )


def _together(spark: SparkSession, task, items: Sequence, limit: int) -> list:
    """Run independent Spark work side by side, as cross-validation in Spark ML does.

    The many small jobs of one fit leave most of a cluster idle.
    """
    with ThreadPool(max(1, min(limit, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(task), items)


def fit_folds(folded: DataFrame, pos_weight: float, cfg: PanelConfig) -> dict[int, GBTClassificationModel]:
    """One model per fold, each fitted without that fold's users.

    The models are those of ``fit`` on the rows of the other folds. Fits with the same number of tasks
    share one layout, from which each leaves out its own fold.
    """
    spark = folded.sparkSession
    width = F.size("x") if is_dense(folded) else F.col("x")["size"]
    sizes = folded.groupBy("fold").agg(F.count("*").alias("n"), F.max(width).alias("width")).collect()  # a row a fold
    of_fold = {r.fold: r.n for r in sizes if r.fold is not None}
    n_rows = sum(of_fold.values())
    tasks = [tasks_of(n_rows - of_fold.get(k, 0), cfg) for k in range(cfg.n_folds)]
    laid_out = {parts: _laid_out(folded, parts, pos_weight, "fold") for parts in set(tasks)}

    def one(k: int) -> GBTClassificationModel:
        return _fitted(laid_out[tasks[k]].filter(F.col("fold") != k).drop("fold"), cfg)

    n_features = max((r.width for r in sizes), default=0)
    at_once = fits_at_once(n_rows, n_features, spark.sparkContext.defaultParallelism, cfg)
    try:
        return dict(enumerate(_together(spark, one, range(cfg.n_folds), at_once)))
    finally:
        for data in laid_out.values():
            data.unpersist()


def oof_scores(folded: DataFrame, models: Mapping[int, GBTClassificationModel]) -> DataFrame:
    """Every row scored by the model that never saw its user."""
    return _union(score(folded.filter(F.col("fold") == k), m) for k, m in models.items())


def in_sample_scores(folded: DataFrame, models: Mapping[int, GBTClassificationModel]) -> DataFrame:
    """Per fold model, its own training rows scored; ``fold`` names the model."""
    return _union(
        score(folded.filter(F.col("fold") != k).withColumn("fold", F.lit(k)), m)
        for k, m in models.items()
    )


def _union(frames) -> DataFrame:
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    return out


# --- model files ------------------------------------------------------------


def save_model(model: GBTClassificationModel, names: Sequence[str], path: str) -> None:
    """The fitted model and, beside it, its ordered feature names."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    feature_table(spark, names).coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str) -> tuple[GBTClassificationModel, list[str]]:
    try:
        features = spark.read.parquet(f"{path}/features").orderBy("idx").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(f"{path}: no saved model; train and save one first") from e
    return GBTClassificationModel.load(f"{path}/model"), [r.sub_feature for r in features]


def tree_nodes(spark: SparkSession, models: Mapping[int, GBTClassificationModel]) -> DataFrame:
    """The nodes of fitted models, from their saved form.

    As many rows as trees times nodes per tree: a model parameter, not data size.
    """

    def nodes_of(item: tuple[int, GBTClassificationModel]) -> DataFrame:
        fold, model = item
        path = fresh_path(spark, "model")
        model.save(path)
        weights = spark.createDataFrame(
            list(enumerate(map(float, model.treeWeights))), "tree int, tree_weight double"
        )
        nodes = spark.read.parquet(f"{path}/data").select(
            F.lit(fold).alias("fold"),
            F.col("treeID").alias("tree"),
            F.col("nodeData.id").alias("node"),
            F.col("nodeData.prediction").alias("prediction"),
            F.col("nodeData.impurityStats").getItem(0).alias("cover"),
            F.col("nodeData.gain").alias("gain"),
            F.col("nodeData.leftChild").alias("left"),
            F.col("nodeData.rightChild").alias("right"),
            F.col("nodeData.split.featureIndex").alias("feature"),
            F.get("nodeData.split.leftCategoriesOrThreshold", 0).alias("threshold"),
        )
        return nodes.join(F.broadcast(weights), "tree")

    return _union(_together(spark, nodes_of, list(models.items()), len(models)))
