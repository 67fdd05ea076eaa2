"""Byte-level BPE with content-defined chunk reuse (operator 2).

A rolling hash cuts every text into chunks at places that depend on the nearby characters
only, so copies and shared passages fall into equal chunks wherever they stand. Chunk hashes
are counted over the corpus; the most repeated chunks are encoded once by a Spark job into a
dictionary of bounded size that every task reads, and a task encodes any other chunk once
and reuses it while it lasts in a bounded store. Where chunks meet, their ids need not agree
with those of the whole text; the join is repaired by encoding the characters around it
again, widened until both ends are places where every reading of the text has a token end.

Such a place is a blank or line end after a character that is not white space: no pre-token of the
vocabulary's pattern reaches across it, and a special token holds no white space. What lies
between the first and last such place of a chunk therefore has the same ids in any context.

Defined cases: a null text counts as empty and has no token; very long texts are cut as any
other; texts without white space have no such place and are encoded whole; repeated rows
give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import column, cut, table

#: Chunks have about 2**CUT_BITS characters, at least LEAST and at most MOST.
CUT_BITS, LEAST, MOST = 11, 128, 8192
WINDOW = 16
#: The dictionary's bound, in characters of chunks, and its least number of occurrences.
DICTIONARY_CHARS, DICTIONARY_COUNT = 8_000_000, 3
#: Chunks that a task keeps.
STORE_CHUNKS = 10_000
#: How ids are packed in the dictionary.
ID = np.dtype("<u4")
#: Runs without white space above this go to the slower library, whose merging stays fast on them.
LONG_RUN = 4096

BLANKS = " \n\t\r"  # white space to every engine
PLACE = re.compile(r"(?<=\S)[ \n\t\r]")


class Codec:
    """The tokenizer's file read for two libraries, and its ids' bytes."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spelled = _byte_of_char()
        self.bytes_of = [b""] * self.slow.get_vocab_size()
        for token, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = bytes(spelled[c] for c in token) if all(c in spelled for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        ranks = {self.bytes_of[i]: i for i in spec["model"]["vocab"].values() if i not in self.special.values()}
        # by bytes, ids are ranks in such files: the 256 bytes first, then merges in order
        self.fast = tiktoken.Encoding("file", pat_str=_pattern(), mergeable_ranks=ranks, special_tokens=self.special)
        self.words = [str(i) for i in range(len(self.bytes_of))]

    def encode(self, text: str) -> list[int]:
        """Ids as the file's own library gives them."""
        if len(text) > LONG_RUN and max(map(len, text.split()), default=0) > LONG_RUN:
            return self.slow.encode(text, add_special_tokens=False).ids
        if any(s in text for s in self.special):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.fast.decode_bytes(ids).decode("utf-8", "replace")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _pattern() -> str:
    # fixed value: the pre-tokenization pattern of byte-level BPE files with "use_regex"
    return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def chunk_ends(text: str) -> list[int]:
    """Ends of the chunks: where a rolling hash of the last WINDOW characters hits, or after MOST characters."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)
    width = 1
    while width < WINDOW:  # the hash of twice as many characters from two neighbours
        left = h[:-width] * np.uint32(pow(0x01000193, width, 1 << 32))
        left += h[width:]
        h, width = left, width * 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    hits = np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + WINDOW
    ends, last = [], 0
    for at in (*hits.tolist(), n):
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST or at == n and at > last:
            ends.append(at)
            last = at
    return ends


def chunk_key(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def core(chunk: str) -> tuple[int, int] | None:
    """First and last place of a chunk where every reading has a token end, if there are two."""
    first = PLACE.search(chunk)
    if not first:
        return None
    last = len(chunk)
    while last > first.start():
        last -= 1
        if chunk[last] in BLANKS and not chunk[last - 1].isspace():
            break
    return (first.start(), last) if last > first.start() else None


class Reader:
    """Encodes texts by chunks. ``shared`` has packed ids of chunk cores; more are kept up to a bound."""

    def __init__(self, tokens: Codec, shared: dict[bytes, bytes]) -> None:
        self.tokens, self.shared, self.store = tokens, shared, OrderedDict()
        self.reused = 0

    def ids_of(self, chunk: str, inner: tuple[int, int]) -> list[int]:
        key = chunk_key(chunk)
        if (packed := self.shared.get(key)) is not None:
            self.reused += 1
            return np.frombuffer(packed, ID).tolist()
        if (packed := self.store.get(key)) is not None:
            self.reused += 1
            return np.frombuffer(packed, ID).tolist()
        ids = self.tokens.encode(chunk[inner[0] : inner[1]])
        self.store[key] = np.array(ids, ID).tobytes()
        if len(self.store) > STORE_CHUNKS:
            self.store.popitem(last=False)
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        done = start = 0  # characters whose ids are settled, and the chunk's start
        for end in chunk_ends(text):
            chunk = text[start:end]
            if inner := core(chunk):
                if start + inner[0] > done:  # the join, from the last agreed place to the next one
                    ids += self.tokens.encode(text[done : start + inner[0]])
                ids += self.ids_of(chunk, inner)
                done = start + inner[1]
            start = end
        if done < len(text):
            ids += self.tokens.encode(text[done:])
        return ids


def chunk_counts(docs: DataFrame) -> DataFrame:
    """(key, chars, n): how often each chunk occurs, combined in each batch before the shuffle."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict[tuple[bytes, int], int] = {}
            for x in batch["text"]:
                text, start = x.as_py() or "", 0
                for end in chunk_ends(text):
                    k = (chunk_key(text[start:end]), end - start)
                    n[k] = n.get(k, 0) + 1
                    start = end
            yield pa.RecordBatch.from_pydict({"key": pa.array([k[0] for k in n], pa.binary()), "chars": pa.array([k[1] for k in n], pa.int64()), "n": pa.array([*n.values()], pa.int64())})

    return docs.select("text").mapInArrow(work, "key binary, chars long, n long").groupBy("key", "chars").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, path: str, chars: int = DICTIONARY_CHARS) -> dict[bytes, bytes]:
    """The ids of the most repeated chunks, each encoded once; ``chars`` bounds their text and so the dictionary.

    Chunks beyond the bound are encoded where they are read: the bound changes the work, never the ids.
    """
    spark = docs.sparkSession
    counted = cut(chunk_counts(docs).where(F.col("n") >= DICTIONARY_COUNT))
    most = counted.orderBy(F.desc("n"), "key").select("key", "chars").limit(max(1, chars // LEAST)).toArrow()
    room = np.cumsum(most["chars"].to_numpy())
    wanted = spark.sparkContext.broadcast(set(most["key"].to_pylist()[: int(np.searchsorted(room, chars, "right"))]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out: dict[bytes, str] = {}
            for x in batch["text"]:
                text, start = x.as_py() or "", 0
                for end in chunk_ends(text):
                    k = chunk_key(text[start:end])
                    if k in wanted.value and k not in seen:
                        seen.add(k)
                        out[k] = text[start:end]
                    start = end
            yield pa.RecordBatch.from_pydict({"key": pa.array([*out], pa.binary()), "chunk": pa.array([*out.values()], pa.string())})

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(path)
        for batch in batches:
            pairs = [(k.as_py(), x[i[0] : i[1]]) for k, c in zip(batch["key"], batch["chunk"], strict=True) if (i := core(x := c.as_py()))]
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in pairs], pa.binary()), "ids": pa.array([np.array(tokens.encode(x), ID).tobytes() for _, x in pairs], pa.binary())})

    if not wanted.value:
        return {}
    chunks = docs.select("text").mapInArrow(work, "key binary, chunk string").groupBy("key").agg(F.first("chunk").alias("chunk"))
    found = chunks.mapInArrow(encode, "key binary, ids binary").toArrow()
    return dict(zip(found["key"].to_pylist(), found["ids"].to_pylist(), strict=True))


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, lossless) of every text, with the ids if asked for."""
    picked = docs.select(column(docs, key, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(picked, path))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(path)
        reader = Reader(tokens, shared.value)
        for batch in batches:
            n, digests, decoded, same, kept = [], [], [], [], []
            for x in batch["text"]:
                t = x.as_py() or ""
                ids = reader.encode(t)
                n.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(tokens.words.__getitem__, ids)).encode()).hexdigest())
                back = tokens.decode(ids)
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == t)
                kept.append(ids if keep_ids else None)
            out = {"doc_id": batch["doc_id"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string()), "lossless": pa.array(same, pa.bool_())}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if keep_ids else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean"
    return picked.mapInArrow(work, schema + ", ids array<int>" * keep_ids)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe_chunks(spark, sf_dir, path: str | None = None):
    return encode_decode(table(spark, sf_dir, "documents"), path or tokenizer_path())
