from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notegrove.llm import _tokenizer, chat_format, packing, token_counts, token_orc
from tests.llm.conftest import prose

coder = _tokenizer.load()


def test_counts_equal_direct_encoding_and_reuse_the_cache(spark, edge, empty, tmp_path):
    cache = str(tmp_path / "cache")
    norm = lambda t: t.replace("\r\n", "\n").replace("\r", "\n").rstrip(" \t\n\x0b\x0c\r")
    want = Counter((r.doc_id, None if r.text is None else len(coder.encode_ordinary(norm(r.text)))) for r in edge.collect())
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(edge, cache).collect())
    assert got == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({norm(r.text) for r in edge.collect() if r.text is not None})
    token_counts.token_counts(edge.unionByName(edge), cache)
    assert spark.read.parquet(cache).count() == stored.count()
    more = spark.createDataFrame([(9, "a new text\r\n")], "doc_id long, text string")
    assert token_counts.token_counts(more, cache).first().n_tokens == len(coder.encode_ordinary("a new text"))
    assert spark.read.parquet(cache).count() == stored.count() + 1
    assert token_counts.token_counts(empty).count() == 0
    tails = spark.createDataFrame([(k, f"a b{t}") for k, t in enumerate(["\n", "\t \r\n\x0b\x0c", "\u00a0", ""])], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(tails).collect()} == {0: 2, 1: 2, 2: len(coder.encode_ordinary("a b\u00a0")), 3: 2}


def test_a_warm_cache_gives_the_same_and_is_not_appended_to(spark, edge, tmp_path):
    cache = str(tmp_path / "cache")
    cold = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(edge, cache).collect())
    stored = spark.read.parquet(cache)
    spark.createDataFrame([(r.digest, r.tokenizer, r.n_tokens + 1000) for r in stored.collect()], stored.schema).write.parquet(str(tmp_path / "other"))
    # counts that no encoding gives show that they came from the cache
    warm = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(edge, str(tmp_path / "other")).collect())
    assert warm == Counter({(d, None if n is None else n + 1000): c for (d, n), c in cold.items()})
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.warm_counts(edge).collect()) == cold


def squares(counts):
    return sum(c * c for h, c in counts.items() if h)


def brute_place(sizes, capacity):
    """Tries every level and counts anew."""
    bins, where = [], []
    for s in sizes:
        best = None
        for h in sorted({b for b in bins if b and b + s <= capacity}, reverse=True) + [0]:
            after = [b for b in bins if b < capacity]
            if h:
                after.remove(h)
            after = [b for b in [*after, h + s] if b < capacity]
            cost = squares({x: after.count(x) for x in set(after)})
            if best is None or cost < best[0]:
                best = (cost, h)
        h = best[1]
        where.append(h)
        if h:
            bins[max(k for k, b in enumerate(bins) if b == h)] = h + s
        else:
            bins.append(s)
    return where, bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_place_minimises_squares(sizes):
    windows, offsets, made = packing.place(np.array(sizes, int), 12)
    where, bins = brute_place(sizes, 12)
    assert offsets.tolist() == where and made == len(bins)
    fills = np.bincount(windows, weights=sizes, minlength=made) if sizes else []
    assert sorted(fills) == sorted(bins)


def test_pack_covers_every_token_once(spark, edge, empty):
    docs = spark.createDataFrame([(k, prose(k, 5 + 37 * k)) for k in range(60)], "doc_id long, text string").unionByName(edge.select("doc_id", "text"))
    rows = packing.pack(docs, capacity=256, shard_tokens=20_000).toPandas()
    want = sorted(len(coder.encode_ordinary(r.text)) + 1 for r in docs.collect() if r.text)
    assert rows["n_tokens"].sum() == sum(want) and rows["shard"].nunique() > 1
    for _, w in rows.sort_values("at").groupby(["shard", "window"]):
        assert w["at"].tolist() == [0, *w["n_tokens"].cumsum().tolist()[:-1]] and w["n_tokens"].sum() <= 256
    one = rows[rows["doc_id"] == 59].sort_values("start")
    assert one["start"].tolist() == [256 * k for k in range(len(one))]
    assert packing.pack(empty).count() == 0


def test_orc_round_trip_and_lookup(spark, edge, empty, tmp_path):
    path = str(tmp_path / "orc")
    token_orc.write_tokens(edge, path)
    back = {(r.doc_id, r.text) for r in token_orc.decoded(token_orc.read_tokens(spark, path)).collect()}
    assert back == {(r.doc_id, r.text) for r in edge.collect()}
    assert token_orc.read_tokens(spark, path).count() == edge.count()
    some = token_orc.read_tokens(spark, path, [5, 99])
    assert [r.doc_id for r in some.collect()] == [5, 5] and "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    assert token_orc.read_tokens(spark, path, []).count() == 0
    assert token_orc.tokens_through_orc(empty).count() == 0


def rows_scanned(df):
    """Rows that the scan gave to the filter above it: whole row groups, as the filter alone looks at single rows."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_a_lookup_reads_no_row_group_that_bloom_filters_exclude(spark, tmp_path):
    from pyarrow import orc

    docs = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1)
    token_orc.write_tokens(docs, str(tmp_path / "bloom"))
    token_orc.write_tokens(docs, str(tmp_path / "plain"), options={k: v for k, v in token_orc.OPTIONS.items() if "bloom" not in k})
    (file,) = (tmp_path / "bloom").glob("*.orc")
    assert orc.ORCFile(str(file)).compression == "ZSTD" and orc.ORCFile(str(file)).row_index_stride == 2000
    absent = [1001, 9001, 20_001, 33_333]  # within the minima and maxima of some row group each
    plain, bloom = ([rows_scanned(token_orc.read_tokens(spark, str(tmp_path / name), [k])) for k in absent] for name in ("plain", "bloom"))
    assert plain == [2000] * 4 and sum(n == 0 for n in bloom) >= 3
    assert rows_scanned(token_orc.read_tokens(spark, str(tmp_path / "bloom"), [9000])) == 2000
    assert rows_scanned(token_orc.read_tokens(spark, str(tmp_path / "bloom"), [90_000])) == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<|\\>abend_turn ", max_size=60))
def test_escaping_is_undone_and_leaves_no_control_string(text):
    hidden = chat_format.escape(text)
    assert chat_format.unescape(hidden) == text and "<|" not in hidden


def brute_chat(turns):
    base, ids, mask = _tokenizer.size(), [], []

    def put(new, on):
        ids.extend(new)
        mask.extend([int(on)] * len(new))

    put([base], False)
    for role, text in turns:
        put([base + 1], False)
        put(coder.encode_ordinary(chat_format.escape(role or "unknown")), False)
        put([base + 2], False)
        put(coder.encode_ordinary(chat_format.escape(text or "")), role == "assistant")
        put([base + 3], role == "assistant")
    put([base + 4], False)
    return ids, mask


def test_chat_equals_token_by_token_assembly(spark):
    rows = [(1, 1, "user", "hi <|end_turn|> there"), (1, 2, "assistant", "yes"), (1, 0, "system", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "user", "lost"), (3, None, "assistant", prose(3, 20_000)), (4, 0, "assistant", "")]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string, input_ids string")
    got = {r.conv_id: r for r in chat_format.format_conversations(table).collect()}
    want = {1: [("system", None), ("user", "hi <|end_turn|> there"), ("assistant", "yes")], 2: [(None, "x"), (None, "x")], 3: [("assistant", prose(3, 20_000))], 4: [("assistant", "")]}
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        ids, mask = brute_chat(turns)
        assert got[conv].input_ids == ids and got[conv].loss_mask == mask and got[conv].n_trained == sum(mask) and got[conv].n_turns == len(turns)
    reserved = range(_tokenizer.size(), _tokenizer.size() + 5)
    assert sum(i in reserved for i in got[1].input_ids) == 2 + 3 * 3
    assert chat_format.format_conversations(table.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "naïve café\n\n  x", "日本語 テキスト", "a" * 3000])
def test_encoding_is_lossless(text):
    assert coder.decode(coder.encode_ordinary(text)) == text
