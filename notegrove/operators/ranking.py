"""Steps after a search: threshold, decay, diversity, boosts, cut and snippets.

Each takes and returns candidates with their query's text in `query` where it counts. Scores change, rows do not
disappear but by the threshold and the cut; `ranked` turns scores into ranks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrove.functions import scalar, text
from notegrove.sources.shared import kept


def ranked(candidates: DataFrame, by: str = "score") -> DataFrame:
    """A column `rank` from 1 in each query: best score first, then chunk_id."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "chunk_id")))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one more column, computed once a row even where it is used for every element of an array."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def threshold(candidates: DataFrame, least: float) -> DataFrame:
    return candidates.filter(F.col("score") >= least)


def reference_date(path: Column, mtime: Column | None = None) -> Column:
    """The day a chunk's age counts from: in its path, else none if evergreen, else its file's change if that is known."""
    day = scalar.path_date(path)
    if mtime is None:
        return day
    return F.coalesce(day, F.when(~scalar.evergreen_path(path), scalar.utc_day(mtime)))


def temporal_decay(candidates: DataFrame, half_life: float, now: Column, files: DataFrame | None = None) -> DataFrame:
    """Scores times e^(-rate * age); what has no date is left as it is. files: (path, mtime), for dates that paths lack."""
    columns = candidates.columns
    if files is None:
        day = reference_date(F.col("path"))
    else:
        candidates = candidates.join(files.select("path", F.col("mtime").alias("__mtime")), "path", "left")
        day = reference_date(F.col("path"), F.col("__mtime"))
    factor = scalar.decay_factor(scalar.age_days(day, now), scalar.decay_rate(half_life))
    return candidates.withColumn("score", F.when(day.isNotNull(), F.col("score") * factor).otherwise(F.col("score"))).select(*columns)


def diversify(candidates: DataFrame, lam: float = 0.7) -> DataFrame:
    """A column `rank` by maximal marginal relevance; scores stay.

    Greedy, so one query's candidates are one Python call. Ties go to the better score, then to chunk_id.
    """
    lam = max(0.0, min(1.0, lam))
    if lam == 1.0:
        return ranked(candidates)
    names = candidates.columns

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "chunk_id"], ascending=[False, True], ignore_index=True)
        score = frame["score"].to_numpy(float)
        low, high = score.min(), score.max()
        relevance = np.ones(len(score)) if high == low else (score - low) / (high - low)
        sets = [frozenset(t) for t in frame.pop("__tokens")]
        nearest, order, left = np.zeros(len(score)), [], np.ones(len(score), bool)
        for _ in range(len(score)):
            value = np.where(left, lam * relevance - (1 - lam) * nearest, -np.inf)
            best = int(np.argmax(value))  # the first of equals has the better score
            order.append(best)
            left[best] = False
            for k in np.flatnonzero(left):
                union = len(sets[k] | sets[best])
                nearest[k] = max(nearest[k], len(sets[k] & sets[best]) / union if union else 1.0)
        frame["rank"] = 0
        frame.loc[order, "rank"] = np.arange(1, len(order) + 1)
        return frame

    schema = candidates.select(*names).schema.add("rank", T.IntegerType())
    return candidates.withColumn("__tokens", text.diversity_tokens(F.col("text"))).groupBy("query_id").applyInPandas(pick, schema).select(*names, "rank")


def cut(ranks: DataFrame, k: int) -> DataFrame:
    return ranks.filter(F.col("rank") <= k)


def results(ranks: DataFrame, snippet_chars: int = 700) -> DataFrame:
    """Ranked candidates as results, texts cut to snippets."""
    return ranks.select("query_id", F.col("rank").cast("int").alias("rank"), "path", "start_line", "end_line", "score", text.snippet(F.col("text"), snippet_chars).alias("snippet"), "source", "vector_score", "text_score")


def one_per_path(candidates: DataFrame) -> DataFrame:
    """The best chunk of each path and query."""
    order = Window.partitionBy("query_id", "path").orderBy(F.desc("score"), "chunk_id")
    return candidates.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")


def _doubt(confidence: Column) -> Column:
    """1 minus confidence over the query's greatest, which counts as 1 unless positive."""
    most = F.max(confidence).over(Window.partitionBy("query_id"))
    return 1 - confidence / F.when(most > 0, most).otherwise(1.0)


def entity_share(candidates: DataFrame) -> DataFrame:
    """A column __share: the share of the query's entities found in the text; null for questions of preference and for queries without any.

    A query without entities is matched by its topic words, repeats included.
    """
    query = F.col("query")
    tagged = once(candidates, "__named", text.entities(query))
    tagged = once(tagged, "__e", F.struct(F.when(F.size("__named") > 0, F.col("__named")).otherwise(text.topic_words(query)).alias("wanted"), F.lower("text").alias("low"), text.asks_for_preference(query).alias("skip")))
    share = F.when(~F.col("__e.skip") & (F.size("__e.wanted") > 0), text.share_found(F.col("__e.wanted"), F.col("__e.low")))
    return once(tagged, "__share", share).drop("__e", "__named")


def by_entities(alpha: Column | float) -> Column:
    boosted = F.least(F.lit(1.0), F.col("score") + F.lit(alpha) * _doubt(F.coalesce("vector_score", "score")) * F.col("__share"))
    return F.when(F.col("__share").isNull(), F.col("score")).otherwise(boosted)


def entity_boost(candidates: DataFrame, alpha: Column | float = 0.3) -> DataFrame:
    """min(1, score + alpha * doubt * share of the query's entities found); see entity_share."""
    return entity_share(candidates).withColumn("score", by_entities(alpha)).drop("__share")


def rarity_overlap(candidates: DataFrame, pairs: bool = False) -> DataFrame:
    """A column __overlap: the share of the query's idf that a chunk holds; null where that idf is not positive.

    idf = ln(sessions / (1 + sessions with the term)) over the query's own candidates; a session is a file stem. A
    pair counts as found in a text as a string, for a session in its chunks joined by spaces in order of score.
    """
    candidates = kept(candidates, "candidates")  # read four times below
    query, words = F.col("query"), F.array_distinct(text.topic_words(F.col("query")))
    terms = F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(False).alias("pair")))
    if pairs:
        terms = F.concat(terms, F.transform(F.array_distinct(text.topic_pairs(query)), lambda w: F.struct(w.alias("term"), F.lit(True).alias("pair"))))
    vocab = candidates.select("query_id", "query").distinct().select("query_id", F.explode(terms).alias("t")).select("query_id", "t.*")
    rows = candidates.select("query_id", "chunk_id", scalar.file_stem(F.col("path")).alias("session"), "text", "score")
    tokens = lambda c: F.array_distinct(text.topic_words(c))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id", "text"))), lambda r: r["text"]), " ")
    sessions = rows.groupBy("query_id", "session").agg(joined.alias("whole")).select("query_id", "session", F.lower("whole").alias("low"), tokens(F.col("whole")).alias("have"))
    total = sessions.groupBy("query_id").agg(F.count("*").alias("n"))
    has = F.when(F.col("pair"), F.contains("low", "term")).otherwise(F.array_contains("have", F.col("term")))
    df = vocab.join(sessions, "query_id").groupBy("query_id", "term", "pair").agg(F.count_if(has).alias("df"))
    idf = df.join(total, "query_id").select("query_id", "term", "pair", F.log(F.col("n") / (1 + F.col("df"))).alias("idf"))
    # in order of term: sums in any other order could differ in their last bit, and ranks with them
    sums = idf.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "pair", "idf"))).alias("idfs"))
    sums = sums.withColumn("sum_idf", F.aggregate("idfs", F.lit(0.0), lambda s, t: s + t["idf"]))
    low, own = F.lower("text"), tokens(F.col("text"))
    with_sums = once(candidates.join(sums, "query_id", "left"), "__t", F.struct(own.alias("own"), low.alias("low")))
    found = F.aggregate(F.filter("idfs", lambda t: F.when(t["pair"], F.contains(F.col("__t.low"), t["term"])).otherwise(F.array_contains(F.col("__t.own"), t["term"]))), F.lit(0.0), lambda s, t: s + t["idf"])
    return once(with_sums, "__overlap", F.when(F.col("sum_idf") > 0, found / F.col("sum_idf"))).select(*candidates.columns, "__overlap")


def by_rarity(alpha: Column | float) -> Column:
    return F.when(F.col("__overlap").isNull(), F.col("score")).otherwise(F.least(F.lit(1.0), F.col("score") * (1 + F.lit(alpha) * F.col("__overlap"))))


def rarity_boost(candidates: DataFrame, alpha: Column | float = 0.6, pairs: bool = False) -> DataFrame:
    """min(1, score * (1 + alpha * overlap)); see rarity_overlap."""
    return rarity_overlap(candidates, pairs).withColumn("score", by_rarity(alpha)).drop("__overlap")


def date_nearness(candidates: DataFrame) -> DataFrame:
    """A column __near: nearness of the chunk's session date to the day that the query speaks of, 0 where either is missing.

    Needs `question_date` (text).
    """
    tagged = once(candidates, "__plain", text.with_digits(F.col("query")))
    tagged = once(tagged, "__o", F.struct(text.digit_offset(F.col("__plain")).alias("offset"), scalar.question_date(F.col("question_date")).alias("asked"), scalar.session_date(F.col("text")).alias("day")))
    target = F.date_sub(F.col("__o.asked"), F.col("__o.offset.days").cast("int"))
    near = scalar.window_score(F.abs(F.datediff(F.col("__o.day"), target)), F.col("__o.offset.tolerance"))
    tagged = once(tagged, "__near", F.when(target.isNotNull() & F.col("__o.day").isNotNull(), near).otherwise(0.0))
    return tagged.drop("__o", "__plain")


def by_date(alpha: Column | float) -> Column:
    boosted = F.least(F.lit(1.0), F.col("score") + F.lit(alpha) * _doubt(F.coalesce("vector_score", "score")) * F.col("__near"))
    return F.when(F.col("__near") > 0, boosted).otherwise(F.col("score"))


def date_boost(candidates: DataFrame, alpha: Column | float = 0.4) -> DataFrame:
    """min(1, score + alpha * doubt * nearness); see date_nearness."""
    return date_nearness(candidates).withColumn("score", by_date(alpha)).drop("__near")


def boosted(candidates: DataFrame, alphas: dict[str, Column | float]) -> DataFrame:
    """The three boosts one after the other. What they weigh is found once, whatever the number of settings that `alphas` stands for."""
    out = candidates
    for name, by, feature in (("ec_alpha", by_entities, "__share"), ("idf_alpha", by_rarity, "__overlap"), ("date_alpha", by_date, "__near")):
        out = out.withColumn("score", by(alphas[name])).drop(feature)
    return out


def boost_features(candidates: DataFrame) -> DataFrame:
    """What `boosted` needs of each candidate."""
    return date_nearness(rarity_overlap(entity_share(candidates)))
