import math
import re

import pytest
from pyspark.sql import functions as F

from notegrove.functions import scalar, text
from notegrove.functions.stopwords import BY_LANGUAGE, STOP_WORDS


def one(spark, expression, *values, kind="string"):
    """The expression of a column for each value."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in rows.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_match_expressions(spark):
    got = one(spark, text.match_expression, "hello world", "FOO_bar baz-1", "???", "   ", "", "数据库", "价格 2026年", "Keep CASE")
    assert got == ['"hello" AND "world"', '"FOO_bar" AND "baz" AND "1"', None, None, None, '"数据库"', '"价格" AND "2026年"', '"Keep" AND "CASE"']


def test_rank_to_score(spark):
    got = one(spark, text.bm25_to_score, -4.2, 0.0, 10.0, float("nan"), float("inf"), float("-inf"), -9.0, kind="double")
    assert got == [pytest.approx(4.2 / 5.2), 1.0, pytest.approx(1 / 11), 0.001, 0.001, 0.001, 0.9]


def test_stop_words(spark):
    assert len(BY_LANGUAGE) == 7 and {"the", "el", "uma", "我", "これ"} <= set(STOP_WORDS)
    assert one(spark, text.is_stop_word, "the", "The", "THE", "database", "的") == [True, False, False, False, True]


def test_keywords(spark):
    got = one(spark, text.keywords, "which database did we pick?", "PostgreSQL postgresql POSTGRESQL pool", "ab 123 abc", "", "the of and")
    assert got == [["database", "pick"], ["PostgreSQL", "pool"], ["abc"], [], []]


def test_expansion(spark):
    got = one(spark, text.expanded_query, "  what about the database ", "???")
    assert got[0].original == "what about the database" and got[0].keywords == ["database"] and got[0].expanded == "what about the database OR database" and got[1] is None


def test_folding_keeps_other_scripts(spark):
    assert one(spark, text.index_tokens, "Ångström été naïve", "Việt straße Ελλάδα", "a_b c-d", "数据库设计") == [["angstrom", "ete", "naive"], ["việt", "straße", "ελλάδα"], ["a", "b", "c", "d"], ["数据库设计"]]


def test_snippets(spark):
    long = "word " * 30
    got = one(spark, lambda c: text.snippet(c, 20), "short", long, "x" * 30, "abc " + "y" * 30)
    assert got == ["short", "word word word word…", "x" * 20 + "…", "abc " + "y" * 16 + "…"]


def test_jaccard(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 1.0, 0.0]


def test_entities_and_signals(spark):
    got = one(spark, text.entities, 'Did "Deep Work" mention Golden Gate Bridge, NASA or real-time follow-up by NASA?', "nothing here")
    assert got == [["deep work", "golden gate bridge", "nasa", "real-time", "follow-up"], []]
    assert one(spark, text.asks_for_preference, "What music do I enjoy?", "what kind of tea", "When was the launch?") == [True, True, False]
    assert one(spark, text.topic_words, "The flights to New York, été x1", "") == [["flights", "york"], []]
    assert one(spark, text.topic_pairs, "book flight york", "book", "") == [["book flight", "flight york"], [], []]


def test_time_offsets(spark):
    got = one(spark, text.time_offset, "two weeks ago", "a couple of days ago", "yesterday", "LAST month", "five months ago", "recently", "never", "a week ago")
    assert [None if r is None else (r.days, r.tolerance) for r in got] == [(14, 5), (2, 2), (1, 1), (30, 7), (150, 10), (14, 14), None, (7, 3)]


def test_paths(spark):
    paths = ["memory/2026-03-28.md", "memory/a/2026-03-28.md", "memory/a/b/2026-01-01.md", "memory/2026-99-01.md", "memory/notes.md", "MEMORY.md", "sessions/x.md", "./memory/2026-01-02.md", "memory\\2026-01-03.md", "memory/2026-04-01_kick.md", "/abs/memory/2026-05-05.md"]
    dates = [None if d is None else d.isoformat() for d in one(spark, scalar.path_date, *paths)]
    assert dates == ["2026-03-28", "2026-03-28", None, None, None, None, None, "2026-01-02", "2026-01-03", None, "2026-05-05"]
    assert one(spark, scalar.evergreen_path, *paths) == [False, False, True, False, True, True, False, False, False, True, False]
    assert one(spark, scalar.evergreen_name, *paths) == [False, False, False, False, True, True, True, False, True, True, False]
    assert one(spark, scalar.source_label, "memory/a.md", "memory/s/a.md", "memory/s/t/a.md", "x/a.md") == ["memory", "s", "s", "external"]
    assert one(spark, lambda c: scalar.relative_key(c, "/ws"), "/ws/memory/a.md", "/wsx/a.md") == ["memory/a.md", "/wsx/a.md"]
    assert one(spark, scalar.file_stem, "a/b.c.md", "a/.md", "plain") == ["b.c", ".md", "plain"]


def test_decay(spark):
    assert [scalar.decay_rate(x) for x in (30.0, 0.0, -1.0, math.inf, math.nan)] == [math.log(2) / 30, 0, 0, 0, 0]
    assert one(spark, lambda c: scalar.decay_factor(c, scalar.decay_rate(30)), 30.0, 0.0, float("nan"), -5.0, kind="double") == [pytest.approx(0.5), 1.0, 1.0, 1.0]
    assert one(spark, lambda c: scalar.window_score(c, F.lit(5)), 5, 10, 15, 16, kind="int") == [1.0, 0.5, 0.0, 0.0]
    assert [str(d) for d in one(spark, scalar.session_date, "Date: 2024/02/03 x", "Date: 2024-13-03", "none")] == ["2024-02-03", "None", "None"]


def test_vectors(spark):
    assert one(spark, scalar.unit, [3.0, 4.0], [0.0, 0.0], kind="array<double>") == [[0.6, 0.8], [0.0, 0.0]]
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [-1.0, -1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(F.round(scalar.cosine(F.col("a"), F.col("b")), 9)).collect()] == [0.0, -1.0, None]
    assert [round(x, 6) for x in rows.select(scalar.mean_vector(F.col("a"), F.col("b"))).first()[0]] == [0.707107, 0.707107]


def test_ids(spark):
    import hashlib

    row = spark.range(1).select(
        scalar.chunk_id(F.lit("s"), F.lit("p"), F.lit(1), F.lit(2), F.lit("h"), F.lit("m")).alias("c"),
        scalar.provider_key(F.lit("p"), F.lit("m"), F.lit(None).cast("string")).alias("k"),
    ).first()
    assert row.c == hashlib.sha256(b"s:p:1:2:h:m").hexdigest() and row.k == hashlib.sha256(b"p:m:").hexdigest()
    assert re.fullmatch("[0-9a-f]{64}", row.k)


def test_keywords_of_documents_equal_brute_force(spark, tmp_path):
    import re

    from notegrove.functions.stopwords import STOP_WORDS
    from notegrove.queries import QUERIES

    texts = {1: "The Rocket rocket ROCKET launched 42 big engines in a day", 2: "", 3: "of the", 4: " ".join(f"Word{k % 70} no{k}" for k in range(200)), 5: "The Rocket rocket ROCKET launched 42 big engines in a day"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        first = {}
        for word in re.findall(r"\w+", text):
            if word.lower() not in STOP_WORDS and not re.fullmatch(r"[a-zA-Z]{1,2}|\d+", word):
                first.setdefault(word.lower(), word)
        return " ".join(first.values())

    assert {r.doc_id: r.keywords for r in QUERIES["keyword_extract"](spark, str(tmp_path)).collect()} == {k: brute(t) for k, t in texts.items()}


def test_keywords_are_found_in_one_pass(spark):
    """As by loops over all words; the words of a text are taken out and sorted once, not once for each use of theirs."""
    texts = ["Aa1 aA1 AA1 x xy XYZ 12 1234 १२ _ __ a_b ab_ ñ ñá Été été ÉTÉ 数据 the The", None, " ".join(f"W{k % 90} w{k % 70} {k} the" for k in range(900))]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, v string").select("k", text.keywords(F.col("v")).alias("x"))
    for t, got in zip(texts, (r.x for r in found.orderBy("k").collect()), strict=True):
        seen, want = set(), []
        for w in re.findall(r"\w+", t or ""):
            if not (re.fullmatch("[a-zA-Z]{1,2}", w) or w.isdecimal() or {w, w.lower()} & set(STOP_WORDS) or w.lower() in seen):
                seen.add(w.lower())
                want.append(w)
        assert got == (want if t is not None else None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
