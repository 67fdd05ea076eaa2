import hashlib
import random

import numpy as np
import pytest

from weftgraph.llm import repeated_spans as R


def by_hand(docs):
    place = lambda i: i if i is not None else 1 << 63
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            first[w] = min(first.get(w, (place(i), s)), (place(i), s))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (place(i), s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((-1 if i is None else i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect())


def test_suffixes_of_a_block():
    rng = random.Random(3)
    for _ in range(40):
        alphabet = rng.choice([b"ab", b"abc", b"abcdefgh"])
        draw = lambda n, a=alphabet: bytes(rng.choice(a) for _ in range(n))
        base = draw(300)
        contexts = [rng.choice([base[(a := rng.randint(0, 130)) : a + rng.randint(100, 168)], draw(120), b"a" * rng.randint(100, 168)]) for _ in range(rng.randint(1, 12))]
        starts = np.array([len(c) - 99 for c in contexts])
        owner, offset, group = R.equal_strings(contexts, starts)
        strings = [contexts[a][b : b + 100] for a, b in zip(owner, offset, strict=True)]
        assert len(strings) == starts.sum() and strings == sorted(strings)
        assert all((strings[i] == strings[i - 1]) == (group[i] == group[i - 1]) for i in range(1, len(strings)))


def test_runs_have_one_anchor_and_are_short():
    rng = random.Random(6)
    for data in (b"a" * 5000, bytes(rng.choice(b"ab") for _ in range(3000)), rng.randbytes(3000)):
        anchor, start, n = R.runs(data)
        assert start[0] == 0 and n.sum() == len(data) - 99 and n.max() <= R.LENGTH - R.GRAM + 1
    assert len(R.runs(b"x" * 99)[0]) == 0


def sample_docs(seed=5):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé \n") for _ in range(900))
    docs = []
    for i in range(240):
        k = rng.random()
        if k < 0.3:
            t = base[rng.randint(0, 500) :][: rng.randint(0, 600)]
        elif k < 0.5:
            t = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 300))) + base[100:260] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 90)))
        elif k < 0.6:
            t = "a" * rng.randint(90, 600)
        else:
            t = rng.choice([None, "", "abab" * rng.randint(1, 100), docs[-1][1] if docs else ""])
        docs.append((rng.randint(0, 200) if i % 10 == 0 else i, t))
    return [*docs, (None, base), (7, docs[7][1]), (7, base[50:400])]


@pytest.mark.parametrize("common", [1e-4, 2.0])
def test_all_cases_against_every_string(spark, monkeypatch, common):
    monkeypatch.setattr(R, "COMMON", common)
    docs = sample_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS ord", "'x' AS seal", "2 AS start")
    assert got(R.remove_repeats(df.repartition(5))) == by_hand(docs)


def test_query(spark, nothing, awkward, folder):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(R.op10_repeated_spans(spark, "/root/testdata/sf0.001")) == by_hand(docs)
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert got(R.op10_repeated_spans(spark, folder(documents=awkward))) == by_hand(rows)
    assert R.op10_repeated_spans(spark, folder(documents=nothing)).collect() == []


def test_kept_text(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdefgh") for _ in range(150))
    rows = {r["doc_id"]: r["kept"] for r in R.remove_repeats(spark.createDataFrame([(1, t), (2, "x" + t + "y")], "doc_id long, text string"), keep_text=True).collect()}
    assert rows == {1: t, 2: "xy"}


def test_texts_under_one_id_get_what_was_found_in_their_own(spark, monkeypatch):
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = draw(150)
    shared = [(7, draw(60) + passage), *[(7, draw(210)) for _ in range(30)]]
    rows = [(1, passage), *shared, (9, passage[20:])]
    assert got(R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == by_hand(rows)
    without = [(None, t) for _, t in shared]
    found = got(R.remove_repeats(spark.createDataFrame([(1, passage), *without], "doc_id long, text string")))
    assert sorted(r[2] for r in found) == [0] * 31 + [150]
    # equal texts without an id are one place, and a passage that two of them share goes from one
    found = got(R.remove_repeats(spark.createDataFrame([(None, "x" + passage), (None, "x" + passage), (None, "yy" + passage)], "doc_id long, text string")))
    assert sorted(r[2] for r in found) in ([0, 0, 150], [0, 150, 150])


def test_seals_of_different_texts_differ(spark):
    sealed = R._sealed(spark.range(200_000).selectExpr("null AS doc_id", "cast(id AS string) AS text"), "doc_id", "text")
    assert sealed.select("ord", "seal").distinct().count() == 200_000 and sealed.where(f"ord < {R.NO_ID}").count() == 0
