import json
import random

import pytest

from notegrove.operators import evaluate
from notegrove.plans import runner
from notegrove.plans.embedders import HashEmbedder
from notegrove.sources import files

TOPICS = ["rocket launch", "sourdough bread", "chess opening", "garden tomato", "violin lesson", "mountain hike", "paint recipe", "train ticket"]


@pytest.fixture(scope="module")
def records():
    rng, out = random.Random(1), []
    for q in range(16):
        topic = TOPICS[q % 8]
        ids = [f"s{q}_{k}" for k in range(6)]
        said = [[{"role": "user", "content": f"Let us talk about {t}. " + " ".join(rng.choice(["really", "often", "maybe", "today"]) for _ in range(20))}, {"role": "assistant", "content": topic}] for t in (topic, *rng.sample([t for t in TOPICS if t != topic], 5))]
        order = rng.sample(range(6), 6)
        out.append({"question_id": f"q{q:02}", "question_type": "ab"[q % 2], "question": f"What did I say about the {topic}?", "question_date": "2024/03/01 (Fri) 10:00", "answer": "x", "haystack_session_ids": [ids[k] for k in order], "haystack_dates": [f"2024/02/{10 + k}" for k in order], "haystack_sessions": [said[k] for k in order], "answer_session_ids": [ids[0]]})
    return out


@pytest.fixture(scope="module")
def questions(spark, records, tmp_path_factory):
    path = tmp_path_factory.mktemp("q") / "questions.json"
    path.write_text(json.dumps(records))
    return runner.from_records(files.read_questions(spark, str(path)))


def test_candidates_come_from_the_own_haystack(spark, questions, records):
    raw = runner.raw_candidates(questions, HashEmbedder()).collect()
    own = {r["question_id"]: set(r["haystack_session_ids"]) for r in records}
    assert len(raw) == 96 and all(r.path.split("/")[-1][:-3] in own[r.query_id] for r in raw)
    assert all(r.text.startswith(f"# Session: {r.path.split('/')[-1][:-3]}\nDate: 2024/02/") and "talk about" in r.text for r in raw)
    embedder = HashEmbedder()
    for r in raw[:10]:
        a, b = embedder.embed_batch([r.query, r.text])
        assert abs(r.score - sum(x * y for x, y in zip(a, b, strict=True))) < 1e-9 and r.score == r.vector_score


def test_a_run_and_its_results(spark, questions, tmp_path):
    rows = runner.run(questions, HashEmbedder())
    got = {r.question_id: r for r in rows.collect()}
    assert len(got) == 16 and all(r.num_sessions == 6 and r.num_results == 6 and len(r.ranked_session_ids) == 6 for r in got.values())
    for r in got.values():
        assert r.recall_1 == float(r.ranked_session_ids[0] in r.answer_session_ids) and r.recall_25 == 1.0
    assert sum(r.recall_3 for r in got.values()) >= 14
    runner.write_run(rows, str(tmp_path / "out"))
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["question_id"] for x in lines[:-1]] == sorted(got) and lines[-1]["kind"] == "summary"
    told = {t["question_type"]: t for t in lines[-1]["types"]}
    assert told["overall"]["n"] == 16 and told["a"]["n"] == told["b"]["n"] == 8 and abs(told["overall"]["recall_1"] - sum(r.recall_1 for r in got.values()) / 16) < 1e-4


def test_seeds(spark, questions):
    by_seed, over = runner.multi_seed(questions, HashEmbedder(), seeds=(1, 2), dev_size=6)
    rows = by_seed.collect()
    assert {(r.seed, r.question_type, r.n) for r in rows} == {(s, t, n) for s in (1, 2) for t, n in (("a", 5), ("b", 5), ("overall", 10))}
    assert all(r[a] in values for r in rows for a, values in evaluate.ALPHAS.items())
    over = {(r.question_type, r.metric): r for r in over.collect()}
    values = [r.recall_1 for r in rows if r.question_type == "overall"]
    assert abs(over["overall", "recall_1"]["mean"] - sum(values) / 2) < 1e-9 and over["overall", "recall_1"]["max"] == max(values)
