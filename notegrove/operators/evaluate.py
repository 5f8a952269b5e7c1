"""Retrieval quality: session rankings, recall, NDCG, summaries, alpha grids and stratified splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrove.functions import scalar

KS = (1, 3, 5, 10, 15, 25)
ALPHAS = {"ec_alpha": (0.2, 0.3, 0.4), "idf_alpha": (0.4, 0.5, 0.6), "date_alpha": (0.1, 0.2, 0.3)}


def session_ranking(ranks: DataFrame) -> DataFrame:
    """(…, session_id, rank): sessions in order of their best chunk, counted anew. A session is a file stem."""
    keys = [c for c in ("query_id", "ec_alpha", "idf_alpha", "date_alpha") if c in ranks.columns]
    best = ranks.groupBy(*keys, scalar.file_stem(F.col("path")).alias("session_id")).agg(F.min("rank").alias("at"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "session_id"))).drop("at")


def per_query(sessions: DataFrame, answers: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """recall_k and ndcg_k of each query (and setting): answers (query_id, session_id).

    Recall is 1 if any answer is among the first k. The ideal order is that of the answers among the first k, not of
    all answers; no answer there gives 0. NDCG is rounded to four digits.
    """
    keys = [c for c in sessions.columns if c not in ("session_id", "rank")]
    right = answers.select("query_id", "session_id").distinct().withColumn("hit", F.lit(1))
    judged = sessions.join(right, ["query_id", "session_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    parts = []
    for k in ks:
        inside = F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)
        parts += [F.max(inside).cast("double").alias(f"recall_{k}"), F.sum(inside / F.log2(F.col("rank") + 1.0)).alias(f"dcg_{k}"), F.sum(inside).cast("int").alias(f"n_{k}")]
    sums = judged.groupBy(*keys).agg(*parts)
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.col(f"n_{k}"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return sums.select(*keys, *(F.col(f"recall_{k}") for k in ks), *(F.round(F.when(F.col(f"n_{k}") > 0, F.col(f"dcg_{k}") / ideal(k)).otherwise(0.0), 4).alias(f"ndcg_{k}") for k in ks))


def summary(scores: DataFrame, by: str = "question_type") -> DataFrame:
    """Means over all queries and over each type, in one pass; the overall row has type 'overall'."""
    metrics = [c for c in scores.columns if c.startswith(("recall_", "ndcg_"))]
    rolled = scores.rollup(by).agg(F.grouping(by).alias("all"), F.count("*").alias("n"), *(F.round(F.avg(m), 4).alias(m) for m in metrics))
    return rolled.withColumn(by, F.when(F.col("all") == 1, F.lit("overall")).otherwise(F.col(by))).drop("all")


def over_seeds(summaries: DataFrame, metrics: list[str], by: str = "question_type") -> DataFrame:
    """Mean, sample deviation, least and greatest of each metric over the seeds, by type."""
    long = summaries.unpivot([by, "seed"], metrics, "metric", "value")
    return long.groupBy(by, "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def alpha_grid(spark, alphas: dict[str, tuple[float, ...]] = ALPHAS) -> DataFrame:
    """Every combination of the settings: a cross join of their values."""
    grid = None
    for name, values in alphas.items():
        one = spark.createDataFrame([(float(v),) for v in values], f"{name} double")
        grid = one if grid is None else grid.crossJoin(one)
    return grid


def _means(scores: DataFrame, settings: tuple[str, ...]) -> DataFrame:
    """Mean recall_5 and ndcg_5 of each setting, from whole ten-thousandths, so that equal settings tie exactly."""
    mean = lambda m: (F.sum(F.round(F.col(m) * 10_000).cast("long")) / F.count("*") / 10_000).alias(m)
    return scores.groupBy(*settings).agg(mean("recall_5"), mean("ndcg_5"))


def best_setting(scores: DataFrame, settings: tuple[str, ...] = tuple(ALPHAS)) -> DataFrame:
    """The setting of greatest mean recall_5, then mean ndcg_5, then smallest values."""
    return _means(scores, settings).orderBy(F.desc("recall_5"), F.desc("ndcg_5"), *settings).limit(1)


def first_better(scores: DataFrame, settings: tuple[str, ...] = tuple(ALPHAS)) -> DataFrame:
    """The first setting, in order of its values, of greatest mean recall_5."""
    return _means(scores, settings).orderBy(F.desc("recall_5"), *settings).limit(1)


def stratified_split(questions: DataFrame, dev_size: int, seed: int) -> DataFrame:
    """(question_id, question_type, part): dev or held_out, types in proportion by largest remainders.

    Within a type the order is that of a digest of seed and id. Equal remainders go to the type that comes first.
    """
    counts = questions.groupBy("question_type").agg(F.count("*").alias("n"))
    total = Window.partitionBy()
    exact = F.col("n") * F.lit(dev_size) / F.sum("n").over(total)
    shares = counts.withColumn("exact", exact).withColumn("whole", F.floor("exact"))
    shares = shares.withColumn("spare", F.lit(dev_size) - F.sum("whole").over(total)).withColumn("nth", F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("whole")), "question_type")))
    quota = shares.select("question_type", (F.col("whole") + (F.col("nth") <= F.col("spare")).cast("long")).alias("quota"))
    order = Window.partitionBy("question_type").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("question_id")), 256), "question_id")
    return questions.join(F.broadcast(quota), "question_type").select("question_id", "question_type", F.when(F.row_number().over(order) <= F.col("quota"), "dev").otherwise("held_out").alias("part"))
