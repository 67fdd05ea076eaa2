"""Language identification by language-bitmask n-gram filters (operator 1).

Training counts, per language, in how many labelled documents each letter n-gram occurs, and
marks an n-gram for every language where it is about as usual as where it is most usual. The
marks go into a bit-sliced Bloom filter: a slot holds one bit per language, so reading an
n-gram's few slots and and-ing them gives all languages that contain it at once. A text's
n-grams vote through per-language popcounts, from which the expected false positives of each
language's filter are taken off.

Defined cases: a null text, an empty one and one without a letter get ``und`` and score 0;
very long texts are read whole; repeated rows get equal answers; ties go to the smallest
language by code point; without usable labelled rows every text gets ``und``; other columns
are ignored. A null id counts as not held out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import column, cut, table

UNKNOWN = "und"
GRAMS = (3, 4)
#: The filter's slots (a power of 2) have eight bytes for every 64 languages, so 8 MB for each of these whatever the corpus.
SLOTS = 1 << 20
HASHES = 3
WORD = 64
#: Training reads a sample of about so many labelled documents of each language, by a hash of the id.
SAMPLE_DOCS = 6000
#: An n-gram is marked where its share of documents is at least SHARE and RATIO of its largest share.
SHARE, RATIO = 0.003, 0.5
#: Texts that a task hands back at once.
TEXTS = 256
#: Letters a working array holds at once, longer texts are gone through in overlapping pieces.
PIECE = 1 << 20

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once in each worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a text's lower-cased words, with a space for whatever is no letter.

    n-grams lie within a word and the spaces at its two ends.
    """
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for low in range(0, len(codes), PIECE):
        part = codes[low : low + PIECE + max(GRAMS) - 1]
        word = _letters()[part]
        part = np.where(word, part, np.uint32(32)).astype(np.uint64)
        for n in GRAMS:
            m = min(len(part) - n + 1, PIECE)
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + part[i : i + m]
            inner = np.ones(m, bool)
            for i in range(1, n - 1):
                inner &= word[i : i + m]
            yield _mix(h[inner])


def slots_of(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th slot of each hash, by double hashing."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h + np.uint64(i) * step) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass(frozen=True)
class Filter:
    """The bit-sliced filter: languages by bit, a mask per slot (a row of them for every WORD languages), each language's false-positive rate."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    def votes(self, text: str) -> tuple[np.ndarray, int]:
        """Corrected popcounts per language, and how many n-grams the text has."""
        counts, total = np.zeros(len(self.languages)), 0
        for h in gram_hashes(text):
            at = [slots_of(h, i) for i in range(HASHES)]
            total += len(h)
            for word, masks in enumerate(np.atleast_2d(self.masks)):
                mask = masks[at[0]]
                for i in range(1, HASHES):
                    mask = mask & masks[at[i]]
                for b in range(word * WORD, min(len(self.languages), (word + 1) * WORD)):
                    counts[b] += np.count_nonzero(mask & np.uint64(1 << b % WORD))
        return np.clip((counts - total * self.false_rate) / (1 - self.false_rate), 0, None), total

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, share): the winner's share of the votes, and of the n-grams, both 0 to 1."""
        if not text or not self.languages:
            return UNKNOWN, 0.0, 0.0
        votes, total = self.votes(text)
        if not total and not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, 0.0
        best = int(np.argmax(votes))
        return self.languages[best], float(votes[best] / max(votes.sum(), 1.0)), float(min(1.0, votes[best] / max(total, 1)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Filter:
    """Fits the filter on a documented sample of ``labelled``; what comes to the driver has the filter's size."""
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    words = -(-len(languages) // WORD)
    if not languages:
        return Filter([], np.zeros((1, SLOTS), np.uint64), np.zeros(0))
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, SAMPLE_DOCS / n))])[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < rate * (1 << 30)).select("lang", "text")
    bits = {k: b for b, k in enumerate(languages)}

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: dict[int, list[np.ndarray]] = {}
            docs: dict[int, int] = {}
            for lang_, text_ in zip(batch["lang"], batch["text"], strict=True):
                b = bits[lang_.as_py()]
                found = [*gram_hashes(text_.as_py())]
                docs[b] = docs.get(b, 0) + 1
                of.setdefault(b, []).append(np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64))
            for b, each in of.items():
                gram, n = np.unique(np.concatenate(each), return_counts=True)
                gram, n = np.append(gram, np.uint64(0)), np.append(n, docs[b])  # gram 0 counts the documents
                yield pa.RecordBatch.from_pydict({"bit": pa.array(np.full(len(gram), b, np.int32)), "gram": pa.array(gram.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    counts = cut(sample.mapInArrow(grams, "bit int, gram long, n long").groupBy("bit", "gram").agg(F.sum("n").alias("n")))
    docs = {r["bit"]: r["n"] for r in counts.where("gram = 0").collect()}
    in_all = F.create_map(*[F.lit(x) for b, n in docs.items() for x in (b, float(n))])[F.col("bit")] if docs else F.lit(1.0)
    shares = F.array_agg(F.struct("bit", "share"))  # at most one of each language
    marked = counts.where("gram <> 0").withColumn("share", F.col("n") / in_all).where((F.col("share") >= SHARE) & (F.col("n") >= 2)).groupBy("gram").agg(shares.alias("of"), F.max("share").alias("most"))
    usual = F.filter("of", lambda x: x["share"] >= RATIO * F.col("most"))
    set_bit = lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"] % WORD))
    in_word = lambda w: F.aggregate(F.filter("usual", lambda x: F.floor(x["bit"] / WORD) == w), F.lit(0).cast("long"), set_bit)
    chosen = marked.select("gram", usual.alias("usual")).select("gram", F.posexplode(F.array(*[in_word(w) for w in range(words)])).alias("word", "mask")).where("mask <> 0")

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, word, mask = batch["gram"].to_numpy().view(np.uint64), batch["word"].to_numpy(), batch["mask"].to_numpy()
            yield pa.RecordBatch.from_pydict({"word": pa.array(np.tile(word, HASHES)), "slot": pa.array(np.concatenate([slots_of(h, i) for i in range(HASHES)])), "mask": pa.array(np.tile(mask, HASHES))})

    filled = chosen.mapInArrow(slots, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most SLOTS rows a word
    masks = np.zeros((words, SLOTS), np.uint64)
    masks[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero(masks[b // WORD] & np.uint64(1 << b % WORD)) / SLOTS for b in range(len(languages))])
    return Filter(languages, masks, np.minimum(fill**HASHES, 0.99))


def identify(docs: DataFrame, model: Filter, key: str = "doc_id", text: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, share) of every text, with the columns of ``keep`` passed on beside them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f"in_{c}" for c in keep]
    # a text that is kept is sent once
    read = f"in_{text}" if text in keep and dict(docs.dtypes)[text] == "string" else "text"
    own = [column(docs, text, "string").alias("text")] if read == "text" else []
    picked = docs.select(column(docs, key, "long").alias("doc_id"), *own, *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, TEXTS) for b in batches for low in range(0, b.num_rows, TEXTS)):
            rows = [shared.value.decide(x.as_py()) for x in batch[read]]
            lang, score, share = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"]} | {k: batch[k] for k in kept} | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "share": pa.array(share, pa.float64())})

    fields = "".join(f", `{k}` {dict(picked.dtypes)[k]}" for k in kept)
    return picked.mapInArrow(work, f"doc_id long{fields}, lang_pred string, score double, share double")


def fit(docs: DataFrame) -> Filter:
    """Learns from the labelled documents that are not held out."""
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"), column(docs, "lang", "string").alias("lang"))
    return train(rows.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "share")
