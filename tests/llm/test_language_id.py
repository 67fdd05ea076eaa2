import collections
import zlib

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import language_id as L


def test_held_out_accuracy(spark):
    rows = L.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert 150 < len(held) < 350 and len(rows) == 1000
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_rows(spark, awkward, folder):
    rows = L.op1_language_id(spark, folder(documents=awkward)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 13
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2, 3, 4, 9))
    assert all(by[i]["lang_pred"] in ("en", "de") for i in (1, 5, 6, 7, 8, 10, 11))
    assert by[None]["held_out"] is False


def test_empty_and_unlabelled(spark, nothing, awkward, folder):
    assert L.op1_language_id(spark, folder(documents=nothing)).collect() == []
    rows = L.op1_language_id(spark, folder(documents=awkward.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}


def grams_by_hand(text):
    """The n-grams of lower-cased words with a space at either end, repeats included."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return [w[i : i + n] for w in (f" {w} " for w in words) for n in L.GRAMS for i in range(len(w) - n + 1)]


def test_votes_against_plain_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    learned = [d for d in docs if d["lang"] is not None and d["text"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2]
    in_docs, n_docs = collections.Counter(), collections.Counter()
    for d in learned:
        n_docs[d["lang"]] += 1
        in_docs.update((d["lang"], g) for g in set(grams_by_hand(d["text"])))
    share = {k: n / n_docs[k[0]] for k, n in in_docs.items() if n / n_docs[k[0]] >= L.SHARE and n >= 2}
    most = {}
    for (_, g), x in share.items():
        most[g] = max(most.get(g, 0), x)
    marked = {(lang, g) for (lang, g), x in share.items() if x >= L.RATIO * most[g]}
    model = L.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert model.languages == sorted(n_docs)
    raw = L.Filter(model.languages, model.masks, np.zeros(len(model.languages)))
    agree = 0
    for d in docs:
        grams = grams_by_hand(d["text"] or "")
        plain = [sum((lang, g) in marked for g in grams) for lang in model.languages]
        votes, total = raw.votes(d["text"] or "")
        assert total == len(grams)
        # the filter misses nothing and adds a few false positives, which the correction takes off
        assert all(0 <= v - n <= 3 + 0.02 * total for v, n in zip(votes, plain, strict=True))
        agree += not total or model.decide(d["text"])[0] == model.languages[int(np.argmax(plain))]
    assert agree >= 0.995 * len(docs)


def test_pieces_do_not_change_votes(monkeypatch):
    import numpy as np

    text = "the cat, and a dog: " * 50
    whole = np.sort(np.concatenate([*L.gram_hashes(text)]))
    monkeypatch.setattr(L, "PIECE", 37)
    assert (np.sort(np.concatenate([*L.gram_hashes(text)])) == whole).all()


def test_false_positives_are_taken_off():
    import numpy as np

    masks = (np.random.default_rng(1).random(L.SLOTS) < 0.5).astype(np.uint64)
    text = " ".join(f"w{i}rd" + "abcdefghij"[i % 10] * 3 + chr(97 + i % 26) for i in range(5000))
    raw, total = L.Filter(["a"], masks, np.zeros(1)).votes(text)
    corrected, _ = L.Filter(["a"], masks, np.array([0.5**L.HASHES])).votes(text)
    assert total > 0 and corrected[0] <= raw[0]
    assert L.Filter(["a"], masks | np.uint64(1), np.array([0.125])).votes(text)[0][0] == total


def test_more_languages_than_a_word_has_bits(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    words = {f"l{i:03d}": ["".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz"], 7)) for _ in range(12)] for i in range(140)}
    text = lambda lang: " ".join(rng.choice(words[lang], 30))
    rows = [(lang, text(lang)) for i, lang in enumerate(words) for _ in range(3 + i % 2)]
    model = L.train(spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string"))
    assert model.languages == sorted(words)
    assert all(model.decide(text(lang))[0] == lang for lang in words)
