"""Benchmark runs: questions, each with a haystack of chat sessions, searched and scored as one batch.

A question searches its own haystack alone, so chunks are joined with questions by question_id. Candidates and what
boosts weigh in them are found once and written; settings and seeds are then arithmetic over that table.

questions: (question_id, question_type, question, question_date, haystack, answer_session_ids), haystack being an array
of struct(session_id, date, turns), turns an array of struct(role, content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrove.config import ChunkingConfig
from notegrove.functions import scalar
from notegrove.operators import evaluate, ranking, search
from notegrove.operators.chunking import chunk_texts
from notegrove.plans.embedders import EmbeddingProvider, embed
from notegrove.sources.files import session_notes
from notegrove.sources.shared import kept

#: Candidates of a question, and sessions that a result names.
LIMIT, NAMED = 800, 50
ALPHAS = {"ec_alpha": 0.3, "idf_alpha": 0.6, "date_alpha": 0.2}
SEEDS = (42, 0, 1, 2, 3)


def from_records(records: DataFrame) -> DataFrame:
    """questions from records that hold session ids, dates and turns in three arrays."""
    haystack = F.arrays_zip(F.col("haystack_session_ids").alias("session_id"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))
    day = lambda s: F.struct(s["session_id"].alias("session_id"), s["date"].alias("date"), F.transform(s["turns"], lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))
    return records.withColumn("haystack", haystack).select("question_id", "question_type", "question", "question_date", F.transform("haystack", day).alias("haystack"), "answer_session_ids")


def haystack_chunks(questions: DataFrame, chunking: ChunkingConfig | None = None) -> DataFrame:
    """(query_id, chunk_id, path, source, start_line, end_line, text): chunks of what users said in a question's sessions."""
    sessions = questions.select(F.col("question_id").alias("query_id"), F.explode("haystack").alias("s"))
    key = F.to_json(F.struct("query_id", F.col("s.session_id").alias("session_id")))  # a session can stand in many haystacks
    turns = sessions.select(key.alias("session_id"), F.col("s.date").alias("date"), F.posexplode("s.turns").alias("turn", "t")).select("session_id", "date", "turn", F.col("t.role").alias("role"), F.col("t.content").alias("text"))
    notes = session_notes(turns).withColumn("k", F.from_json("session_id", "query_id string, session_id string"))
    header = F.concat(F.lit("# Session: "), F.col("k.session_id"))
    named = notes.select(F.col("k.query_id").alias("query_id"), F.concat(F.lit("memory/sessions/"), "k.session_id", F.lit(".md")).alias("path"), F.concat(header, F.substring("text", F.instr("text", "\nDate: "), F.length("text"))).alias("text"))
    made = chunk_texts(named.withColumn("source", F.lit("sessions")), chunking)
    return made.withColumn("chunk_id", F.concat_ws(":", "query_id", "path", F.lpad(F.col("chunk_no").cast("string"), 6, "0"))).drop("chunk_no")


def raw_candidates(questions: DataFrame, provider: EmbeddingProvider, limit: int = LIMIT, chunking: ChunkingConfig | None = None) -> DataFrame:
    """The `limit` chunks nearest to each question in its haystack, as they are before any boost, with query and question_date.

    Every distinct text is embedded once.
    """
    chunks = kept(haystack_chunks(questions, chunking), "haystacks")
    hashed = lambda df, c: df.withColumn("hash", scalar.sha256(F.col(c)))
    asked = questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("query"), F.coalesce("question_date", F.lit("")).alias("question_date"))
    texts = hashed(chunks.select("text").union(asked.select("query")).distinct(), "text")
    vectors = kept(embed(texts, provider), "vectors").filter("embedding IS NOT NULL")
    asked = hashed(asked, "query").join(vectors.withColumnRenamed("embedding", "vec"), "hash").drop("hash")
    near = hashed(chunks, "text").join(vectors, "hash").join(asked, "query_id").withColumn("score", scalar.cosine(F.col("embedding"), F.col("vec"))).filter("score IS NOT NULL")
    best = search.top(near, limit)
    return best.select("query_id", "chunk_id", *search.PARTS, "score", F.col("score").alias("vector_score"), F.lit(None).cast("double").alias("text_score"), "query", "question_date")


def answers_of(questions: DataFrame) -> DataFrame:
    return questions.select(F.col("question_id").alias("query_id"), F.explode("answer_session_ids").alias("session_id"))


def features(candidates: DataFrame) -> DataFrame:
    """What boosts need of the captured candidates, without their texts, written once."""
    return kept(ranking.boost_features(candidates).drop("text", "query", "question_date"), "features")


def rows_of_run(found: DataFrame, questions: DataFrame, alphas: dict[str, Column | float] | None = None) -> DataFrame:
    """A row a question: its type, answers, ranked sessions, numbers of sessions and results, recall_k and ndcg_k."""
    ranks = ranking.ranked(ranking.boosted(found, alphas or ALPHAS))
    sessions = kept(evaluate.session_ranking(ranks), "sessions")
    first = sessions.filter(F.col("rank") <= NAMED).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "session_id"))), lambda s: s["session_id"]).alias("ranked_session_ids"))
    measured = evaluate.per_query(sessions, answers_of(questions))
    asked = questions.select(F.col("question_id").alias("query_id"), "question_type", "question", "answer_session_ids", F.size("haystack").alias("num_sessions"))
    results = found.groupBy("query_id").agg(F.count("*").alias("num_results"))
    rows = asked.join(results, "query_id", "left").join(first, "query_id", "left").join(measured, "query_id", "left")
    metrics = [c for c in measured.columns if c != "query_id"]
    return rows.na.fill(0, ["num_results"]).na.fill(0.0, metrics).withColumnRenamed("query_id", "question_id")


def sweep(found: DataFrame, questions: DataFrame, alphas: dict[str, tuple[float, ...]] = evaluate.ALPHAS) -> dict[str, float]:
    """The best of all combinations of settings on some questions."""
    spark, keys = found.sparkSession, list(alphas)
    some = found.join(questions.select(F.col("question_id").alias("query_id")), "query_id", "left_semi")
    rows = some.crossJoin(F.broadcast(evaluate.alpha_grid(spark, alphas)))  # 27 rows
    each = rows.withColumn("real_id", F.col("query_id")).withColumn("query_id", F.concat_ws("|", "query_id", *keys))
    ranks = ranking.ranked(ranking.boosted(each, {a: F.col(a) for a in keys})).withColumn("query_id", F.col("real_id"))
    best = evaluate.best_setting(evaluate.per_query(evaluate.session_ranking(ranks), answers_of(questions), (5,)), tuple(keys)).first()
    return {a: best[a] for a in keys} if best else {a: ALPHAS[a] for a in keys}


def run(questions: DataFrame, provider: EmbeddingProvider, alphas: dict[str, float] | None = None, chunking: ChunkingConfig | None = None) -> DataFrame:
    """One run over all questions: see rows_of_run."""
    return rows_of_run(features(raw_candidates(questions, provider, chunking=chunking)), questions, alphas)


def multi_seed(questions: DataFrame, provider: EmbeddingProvider, seeds: tuple[int, ...] = SEEDS, dev_size: int = 50, chunking: ChunkingConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(seed, settings, question_type, n, metrics) on held-out questions, settings tuned on each seed's dev part; and over_seeds of it.

    The loop is over seeds; candidates are searched and embedded once for all of them.
    """
    found, told = features(raw_candidates(questions, provider, chunking=chunking)), None
    for seed in seeds:
        split = kept(evaluate.stratified_split(questions.select("question_id", "question_type"), dev_size, seed), "split")
        part = lambda name: questions.join(split.filter(F.col("part") == name).select("question_id"), "question_id", "left_semi")  # noqa: B023, E731
        alphas = sweep(found, part("dev"))
        held = found.join(part("held_out").select(F.col("question_id").alias("query_id")), "query_id", "left_semi")
        rows = evaluate.summary(rows_of_run(held, part("held_out"), alphas)).select(F.lit(seed).alias("seed"), *(F.lit(v).alias(a) for a, v in alphas.items()), "*")
        told = rows if told is None else told.unionByName(rows)
    told = kept(told, "seeds")
    return told, evaluate.over_seeds(told, [c for c in told.columns if c.startswith(("recall_", "ndcg_"))])


def write_run(rows: DataFrame, path: str, alphas: dict[str, float] | None = None) -> None:
    """JSON lines in order of question_id; the last line of the last file is the summary."""
    lines = rows.select(F.lit(0).alias("last"), "question_id", F.to_json(F.struct(*rows.columns)).alias("value"))
    settings = [F.lit(v).alias(a) for a, v in (alphas or ALPHAS).items()]
    metrics = [c for c in rows.columns if c.startswith(("recall_", "ndcg_"))]
    by_type = evaluate.summary(rows).select(F.struct("question_type", "n", *metrics).alias("s"))
    summary = by_type.agg(F.sort_array(F.collect_list("s")).alias("types")).select(F.lit(1).alias("last"), F.lit("").alias("question_id"), F.to_json(F.struct(F.lit("summary").alias("kind"), *settings, "types")).alias("value"))
    lines.unionByName(summary).orderBy("last", "question_id").select("value").write.mode("overwrite").text(path)
