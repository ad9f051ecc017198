"""Learned models: item vectors, context vectors by SVD, rankers and an imputer, all on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, StandardScaler, Tokenizer, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wicker.operators import evaluation

FEATURES = ["coverage", "pantry_share", "n_matched", "n_missing", "n_items", "sub_max", "sub_mean"]


#: Records that one partition of a skip-gram model is trained on; their vectors are averaged after each step.
VECTOR_RECORDS = 50_000


def item_vectors(records: DataFrame, size: int = 32, seed: int = 42, steps: int = 3):
    """A skip-gram model over the shuffled items of each record; compare its rankings, not its vectors."""
    parts = max(1, records.count() // VECTOR_RECORDS)
    shuffled = records.select(F.array_sort(F.transform("items", lambda x: F.struct(F.xxhash64("key", x).alias("h"), x.alias("x")))).alias("s"))
    texts = shuffled.select(F.transform("s", lambda r: r["x"]).alias("words"))
    return Word2Vec(vectorSize=size, windowSize=50, maxIter=steps, minCount=1, seed=seed, inputCol="words", outputCol="v", numPartitions=parts).fit(texts)


def svd_vectors(matrix: DataFrame, dims: int) -> DataFrame:
    """item, vector (unit length): rows u * s of a truncated SVD of a symmetric matrix (i, j, v) over a bounded vocabulary.

    Found by subspace iteration with the sparse product as a join; only the small dims x dims factors come to the driver.
    Needs a checkpoint folder, which cuts the lineage of each step.
    """
    import numpy as np

    matrix = matrix.checkpoint()
    names = matrix.select(F.col("i").alias("item")).distinct()
    gauss = F.array(*[F.sqrt(-2 * F.log((F.pmod(F.xxhash64("item", F.lit(f"a{d}")), F.lit(1 << 20)) + 1) / float((1 << 20) + 1))) * F.cos(F.pmod(F.xxhash64("item", F.lit(f"b{d}")), F.lit(1 << 20)) / float(1 << 20) * 6.283185307179586) for d in range(dims)])
    q = names.select("item", gauss.alias("q"))
    for _ in range(4):
        terms = matrix.join(q.withColumnRenamed("item", "j"), "j")
        y = terms.groupBy("i").agg(*[F.sum(F.col("v") * F.col("q")[d]).alias(f"y{d}") for d in range(dims)])
        y = y.select(F.col("i").alias("item"), F.array(*[F.col(f"y{d}") for d in range(dims)]).alias("y")).checkpoint()
        gram = y.agg(*[F.sum(F.col("y")[a] * F.col("y")[b]).alias(f"g{a}_{b}") for a in range(dims) for b in range(a, dims)]).first()
        g = np.array([[gram[f"g{min(a, b)}_{max(a, b)}"] for b in range(dims)] for a in range(dims)])
        values, vectors = np.linalg.eigh(g)
        values = np.where(values > 1e-12 * max(values[-1], 1e-300), values, 0.0)  # directions the matrix doesn't have
        w = vectors[:, ::-1] * np.where(values[::-1] > 0, 1 / np.sqrt(np.where(values[::-1] > 0, values[::-1], 1.0)), 0.0)
        q = y.select("item", F.array(*[sum(F.col("y")[a] * F.lit(float(w[a, d])) for a in range(dims)) for d in range(dims)]).alias("q"))
    scale = np.sqrt(np.sqrt(np.maximum(values[::-1], 0)))
    rows = q.select("item", F.array(*[F.col("q")[d] * F.lit(float(scale[d] ** 2)) for d in range(dims)]).alias("r"))
    norm = F.sqrt(F.aggregate("r", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("item", F.transform("r", lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("vector"))


def candidate_features(pooled: DataFrame) -> DataFrame:
    """``pooled`` (as of ``blocks.featured_pools``) with ``FEATURES``, its label and the weight that makes queries count the same."""
    missing = F.col("n_items") - F.col("n_matched")
    return pooled.select(
        "qid", "rid", (F.col("n_matched") / F.col("n_items")).alias("coverage"), (F.col("n_matched") / F.col("n_held")).alias("pantry_share"), "n_matched",
        missing.alias("n_missing"), "n_items", "sub_max", F.coalesce(F.try_divide("sub_sum", missing), F.lit(0.0)).alias("sub_mean"),
        F.col("label").cast("double").alias("label"), (1.0 / F.col("n_pool")).alias("weight"),
    )


def linear_ranker(rows: DataFrame, columns: list[str] = FEATURES) -> Pipeline:
    assembler = VectorAssembler(inputCols=columns, outputCol="raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    return Pipeline(stages=[assembler, scaler, LogisticRegression(maxIter=50, regParam=1e-4)]).fit(rows)


def pairwise_ranker(rows: DataFrame, columns: list[str] = FEATURES):
    """A linear scorer trained on differences between the gold and the other candidates of its query (both signs)."""
    gold = rows.where("label = 1").select("qid", F.array(*columns).alias("g"))
    others = rows.where("label = 0").select("qid", "rid", F.array(*columns).alias("o"))
    pairs = others.join(gold, "qid").select("rid", F.zip_with("g", "o", lambda a, b: a - b).alias("d"))
    sign = F.pmod(F.xxhash64("rid"), F.lit(2)).cast("double")
    signed = pairs.select(sign.alias("label"), *[F.when(sign == 1, F.col("d")[i]).otherwise(-F.col("d")[i]).alias(c) for i, c in enumerate(columns)])
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), LogisticRegression(maxIter=50, regParam=1e-4, fitIntercept=False)]).fit(signed)


def boosted_ranker(rows: DataFrame, columns: list[str] = FEATURES, trees: int = 20):
    """Gradient boosted trees on the labels, weighted so that each query counts the same."""
    if "weight" not in rows.columns:
        rows = rows.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("qid")))
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), GBTRegressor(maxIter=trees, maxDepth=4, weightCol="weight", seed=42)]).fit(rows)


def rank_with(model, rows: DataFrame, k: int) -> DataFrame:
    """qid, rank, rid by the score of a model, ties by id; k of 0 or less gives nothing."""
    out = model.transform(rows)
    score = vector_to_array("rawPrediction")[1] if "rawPrediction" in out.columns else F.col("prediction")
    order = Window.partitionBy("qid").orderBy(F.desc("s"), "rid")
    return out.select("qid", "rid", score.alias("s")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 0)).select("qid", "rank", "rid")


def split_queries(queries: DataFrame, share: int = 80) -> tuple[DataFrame, DataFrame]:
    """Training and held-out queries by the hash of their id."""
    train = evaluation.is_train(F.col("qid"), share)
    return queries.where(train), queries.where(~train)


def text_imputer(rows: DataFrame, text: str, target: str):
    """Ridge regression of a value on hashed words of a text; fit on rows that have the value."""
    stages = [
        Tokenizer(inputCol=text, outputCol="words"),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=256),
        Normalizer(inputCol="tf", outputCol="features"),
        LinearRegression(labelCol=target, regParam=0.01, elasticNetParam=0.0, standardization=False),
    ]
    return Pipeline(stages=stages).fit(rows.where(F.col(target).isNotNull() & F.col(text).isNotNull()))
