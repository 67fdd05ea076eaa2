import re

import pytest

from weftgraph.llm import source_mix as M


def by_hand(sizes):
    """Targets by resharing the excess until none is above its bound."""
    weights = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, full, open_ = 1.5 * sum(sizes.values()), {}, dict(weights)
    while open_:
        level = left / sum(open_.values())
        over = [s for s in open_ if open_[s] * level >= 2 * sizes[s]]
        if not over:
            return {**full, **{s: w * level for s, w in open_.items()}}
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]
            del open_[s]
    return full


def check(rows, sources):
    # each shard's last block is short: half a block a shard, on average
    sizes, taken = {}, {}
    for r in rows:
        s = sources[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    targets = by_hand(sizes)
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= M.BLOCK * (3 + sizes[s] / M.SHARD_WORDS) + 0.002 * targets[s], (s, taken[s], targets[s])


def test_real_sources(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = M.op3_source_mix(spark, folder).collect()
    assert len(rows) == len(docs)
    sizes = {d["doc_id"]: len(re.findall(M.WORD, d["text"])) for d in docs}
    assert all(r["size"] == sizes[r["doc_id"]] for r in rows)
    check(rows, {d["doc_id"]: d["source"] for d in docs})
    assert sorted(rows) == sorted(M.op3_source_mix(spark, folder).collect()), "reruns agree"


def test_awkward_rows(spark, awkward, nothing, folder, monkeypatch):
    monkeypatch.setattr(M, "SHARD_WORDS", 1000)
    rows = M.op3_source_mix(spark, folder(documents=awkward)).collect()
    assert len(rows) == 13
    check(rows, {r["doc_id"]: r["source"] for r in awkward.collect()})
    assert M.op3_source_mix(spark, folder(documents=nothing)).collect() == []


def test_many_shards_and_sources_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_WORDS", 200)
    monkeypatch.setattr(M, "SENT_SOURCES", 0)
    docs = spark.createDataFrame([(i, "w " * (i % 97), None if i % 11 == 0 else "s" * (1 + i % 5)) for i in range(900)], "doc_id long, text string, source string")
    rows = M.mix(docs).collect()
    check(rows, {r["doc_id"]: r["source"] for r in docs.collect()})


def highest_quotients(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max(votes, key=lambda k: (votes[k] / (2 * won[k] + 1), -ord(k)))
        won[best] += 1
    return won


@pytest.mark.parametrize("votes", [{"a": 5, "b": 5, "c": 5}, {"a": 1000, "b": 1, "c": 1, "d": 1, "e": 1}, {"a": 53, "b": 24, "c": 23}, {"a": 7}, {"a": 3, "b": 0, "c": 9}, {c: 1 for c in "abcdefghij"} | {"z": 500}])
@pytest.mark.parametrize("seats", [0, 1, 2, 7, 50, 333])
def test_apportionment(spark, votes, seats):
    df = spark.createDataFrame([(k, float(x), seats, 10**6) for k, x in votes.items()], "name string, votes double, seats long, bound long")
    got = {r["name"]: r["blocks"] for r in M.apportion(df, [], ["name"]).collect()}
    want = highest_quotients({k: x for k, x in votes.items() if x}, seats)
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n}


def test_mixed_repeats_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = M.mixed(docs)
    assert out.columns == docs.columns
    words = out.select(M.words(out["text"]).alias("n")).groupBy().sum("n").first()[0]
    total = docs.select(M.words(docs["text"]).alias("n")).groupBy().sum("n").first()[0]
    assert 1.3 * total < words < 1.7 * total


def test_rows_without_words_lie_on_several_shards(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_ROWS", 50)
    docs = spark.range(400).selectExpr("id AS doc_id", "if(id < 3, 'a few words here', if(id % 2 = 0, '', null)) AS text", "'s' AS source")
    rows = M.mix(docs).collect()
    assert len(rows) == 400 and {r["size"] for r in rows} == {0, 4} and all(r["taken"] <= 2 * r["size"] for r in rows)


def test_mixing_beside_columns_of_the_same_names(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "repeat('word ', 100) AS text", "'s' AS source", "1 AS copies", "2 AS mix_id", "3 AS mix_source", "4 AS mix_size")
    out = M.mixed(docs)
    assert out.columns == docs.columns and 60 <= out.count() <= 90
