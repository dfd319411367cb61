"""Topics of text units: pooled vectors, clusters, keywords and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from .similarity import mean_pool

OUTLIER = -1


def fit_topics(units: DataFrame, nr_topics: int, min_topic_size: int = 2, seed: int = 1) -> DataFrame:
    """units (unit_id, vec of doubles) with topic_id by k-means; clusters below the least size are outliers, -1.

    Topics are numbered by falling size.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = units.select("unit_id", "vec", array_to_vector("vec").alias("features"))
    model = KMeans(k=nr_topics, seed=seed, featuresCol="features", predictionCol="cluster").fit(data)
    found = model.transform(data).select("unit_id", "vec", "cluster")
    size = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "cluster")) - 1  # a row for each cluster
    size = size.withColumn("topic_id", F.when(F.col("n") >= max(2, min_topic_size), rank).otherwise(OUTLIER))
    return found.join(F.broadcast(size.select("cluster", "topic_id")), "cluster").select("unit_id", "topic_id", "vec")


def centroids(units: DataFrame, topic: str = "topic_id", vector: str = "vec") -> DataFrame:
    """topic, dim, x: mean vectors of topics without the outliers."""
    return mean_pool(units.filter(F.col(topic) != OUTLIER), topic, vector)


def as_vectors(rows: DataFrame, key: str) -> DataFrame:
    """key, dim, x rows as key, vec."""
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda r: r["x"]).alias("vec"))


def compare(topics: DataFrame, predefined: DataFrame, top: int = 3) -> DataFrame:
    """Cosine of every topic (topic_id, vec) with every predefined one (predefined_topic, vec), and whether it is in the top.

    Both sides are lists of topics, so all pairs are the result.
    """
    pairs = topics.select("topic_id", F.col("vec").alias("a")).crossJoin(predefined.select("predefined_topic", F.col("vec").alias("b")))
    score = V.dot(F.col("a"), F.col("b")) / (V.norm(F.col("a")) * V.norm(F.col("b")) + 1e-10)
    scored = pairs.select("topic_id", "predefined_topic", score.alias("similarity_score"))
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("similarity_score"), "predefined_topic"))
    return scored.select(F.col("topic_id").alias("discovered_topic_id"), "predefined_topic", "similarity_score", (rank <= top).alias("is_top_match"))


def keywords(tokens: DataFrame, topic: str = "topic_id", top: int = 10) -> DataFrame:
    """The words of a topic with the highest class-based tf-idf: tf ln(1 + A / f), A the mean words of a topic."""
    tf = tokens.groupBy(topic, "token").agg(F.count(F.lit(1)).alias("n"))
    size = tf.groupBy(topic).agg(F.sum("n").alias("words"))
    every = size.agg(F.avg("words").alias("mean_words"))
    f = tf.groupBy("token").agg(F.sum("n").alias("f"))
    scored = tf.join(f, "token").join(size, topic).crossJoin(F.broadcast(every))  # one row
    score = F.col("n") / F.col("words") * F.log(1 + F.col("mean_words") / F.col("f"))
    scored = scored.select(topic, "token", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc(F.round("score", 9)), "token"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select(topic, "rank", F.col("token").alias("keyword"), "score")


def topic_info(assignments: DataFrame, topic: str = "topic_id") -> DataFrame:
    return assignments.groupBy(topic).agg(F.count(F.lit(1)).alias("n_units"))


def top_topics(probabilities: DataFrame, key: str, top: int = 3) -> DataFrame:
    """key, topic_id, probability rows to the first few of each key with their rank."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("probability"), "topic_id"))
    return probabilities.withColumn("rank", rank).filter(F.col("rank") <= top).select(key, "rank", "topic_id", "probability")


def document_distribution(assignments: DataFrame, key: str) -> DataFrame:
    """assignments (key, topic_id, probability) to each key's topics with count, proportion and mean probability."""
    n = assignments.groupBy(key, "topic_id").agg(F.count(F.lit(1)).alias("count"), F.avg("probability").alias("avg_probability"))
    share = F.col("count") / F.sum("count").over(Window.partitionBy(key))
    return n.select(key, "topic_id", "count", share.alias("proportion"), "avg_probability")
