"""Removal of repeated byte strings by suffix sorting (operator 10).

A byte goes if a string of LENGTH bytes around it also starts earlier in the corpus. Every
string has an anchor, its smallest k-gram by hash, so equal strings share an anchor and only
strings under one anchor need comparing:

1. Texts are cut into runs of string starts with one anchor; a run's context is the bytes its
   strings cover. Runs are dealt by anchor. A run whose whole context occurs earlier is
   settled; an anchor with several different contexts leaves their first runs open.
2. Open contexts are fetched from their texts and dealt by anchor again. Each task joins
   whole anchors to bounded blocks and sorts a block's suffixes in two stages: suffixes
   smaller than their successors are sorted directly, the others are induced by bucket scans.
   Adjacent common prefixes of LENGTH or more then give the equal strings.
3. The settled and found starts go back to their documents.

Equal contexts within a batch are settled before the shuffle. Anchors that a sample shows
in a large share of documents, or that turn out to have very many contexts, are dealt by
context and then by single strings, with the first of each combined before the shuffle, so
no anchor has to fit in one task.

Defined cases: a null text counts as empty; texts under LENGTH bytes keep all; very long
texts are worked through whole; order is by id and start alone, so rows with equal ids are
one place and do not remove each other at equal starts, but each gets back only what was found
in its own text; rows with a null id come after all ids below 2**62, each text at a place drawn from it; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import column, cut, settled, table

LENGTH = 100
GRAM = 32
#: Contexts under an anchor that are compared in one block, and a block's bytes, about.
MOST_CONTEXTS, BLOCK_BYTES = 16_384, 1 << 21
#: The sample that tells which anchors are common, in documents, and the share that makes them so.
SAMPLE_DOCS, COMMON = 20_000, 0.005
#: Texts without an id have places from here on.
NO_ID = 1 << 62

SETTLED, PLAIN, SPREAD = 0, 1, 2


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of each GRAM bytes, by doubling."""
    h, width = np.frombuffer(data, np.uint8).astype(np.uint64), 1
    h += np.uint64(1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    while width < GRAM:
        left = h[:-width] * np.uint64(pow(0x100000001B3, width, 1 << 64))
        left += h[width:]
        h, width = left, width * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, have = h, 1
    while have * 2 <= width:
        m, have = np.minimum(m[:-have], m[have:]), have * 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, starts) of the maximal runs of string starts with one leftmost anchor."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(data)
    m = sliding_min(h, LENGTH - GRAM + 1)
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (h[: len(m) - 1] == m[:-1])
    at = np.flatnonzero(new)
    # 48 bits are enough to deal runs by: different anchors with equal ones only meet needlessly
    return m[at] & ~np.uint64(0xFFFF), at, np.diff(np.append(at, len(m)))


# ---- suffix sorting of a block ----


def sort_directly(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions ordered by their first LENGTH bytes; ``keys`` has eight bytes from each position."""
    if not len(at):
        return at
    order = at[np.argsort(keys[at], kind="stable")]
    first = keys[order]
    group = np.cumsum(np.concatenate(([0], first[1:] != first[:-1])))
    for depth in range(8, LENGTH, 8):
        # only positions whose neighbours are still equal are sorted further
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        part, of = order[where], group[where]
        key = keys[part + depth]
        to = np.lexsort((key, of))
        part, key, of = part[to], key[to], of[to]
        order[where] = part
        new = np.concatenate(([True], (of[1:] != of[:-1]) | (key[1:] != key[:-1])))
        # groups keep their order and are counted anew
        start = np.concatenate(([True], group[1:] != group[:-1]))
        start[where] = new
        group = np.cumsum(start)
    return order


def suffix_order(codes: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """All suffixes of the first ``n`` values ordered by LENGTH values at least, in two stages."""
    text = codes[:n]
    differs = text[:-1] != text[1:]
    falls = np.zeros(n, bool)
    falls[-1] = True  # the last suffix is larger than the empty one after it
    falls[:-1] = text[:-1] > text[1:]
    # equal neighbours take the type of the next differing place
    next_place = np.minimum.accumulate(np.where(np.append(differs, True), np.arange(n), n)[::-1])[::-1]
    falls = falls[next_place]
    rising = sort_directly(keys, np.flatnonzero(~falls))
    bounds = np.searchsorted(text[rising], np.arange(257 + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    # the empty suffix comes first; the last suffix is its predecessor
    waiting[int(text[-1])].append(np.array([n - 1]))
    out = []
    for c in np.unique(text).tolist():
        found = waiting[c]
        level = np.concatenate(found) if found else np.zeros(0, np.int64)
        larger = [level]
        while len(level):  # predecessors with the same value come behind, in order
            before = level[level > 0] - 1
            level = before[falls[before] & (text[before] == c)]
            larger.append(level)
        bucket = np.concatenate([*larger, rising[bounds[c] : bounds[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]  # larger than their successors, in a later bucket
        to = np.argsort(text[before], kind="stable")
        before = before[to]
        values, first = np.unique(text[before], return_index=True)
        for value, part in zip(values.tolist(), np.split(before, first[1:]), strict=bool(len(values))):
            waiting[value].append(part)
    return np.concatenate(out)


def equal_strings(contexts: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, group) of every string start, equal strings in one group, in suffix order."""
    sizes = np.array([len(c) for c in contexts])
    n = int(sizes.sum()) + len(contexts)
    # bytes of UTF-8 end at 0xF4, so that bytes + 1 leave 0 for the end of each context
    codes = np.zeros(n + LENGTH + 16, np.uint8)
    body = np.ones(n, bool)
    ends = np.cumsum(sizes + 1) - 1
    body[ends] = False
    codes[:n][body] = np.frombuffer(b"".join(contexts), np.uint8) + np.uint8(1)
    keys, width = codes.astype(np.uint64), 1
    while width < 8:  # the eight values from each position as one number
        ahead = np.zeros_like(keys)
        ahead[:-width] = keys[width:]
        keys, width = (keys << np.uint64(8 * width)) | ahead, width * 2
    order = suffix_order(codes, keys, n)
    begin = np.concatenate(([0], ends[:-1] + 1))
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    offset = np.arange(n) - begin[owner]
    order = order[offset[order] < starts[owner[order]]]
    same = np.ones(max(len(order) - 1, 0), bool)
    a, b = order[:-1], order[1:]
    for depth in (*range(0, LENGTH - 8, 8), LENGTH - 8):  # adjacent common prefixes, as far as they matter
        left = np.flatnonzero(same)
        same[left] = keys[a[left] + depth] == keys[b[left] + depth]
    group = np.cumsum(np.concatenate(([0], ~same))) if len(order) else order
    return owner[order], offset[order], group


# ---- the Spark jobs ----

# A run's start, its starts (7 bits, at most LENGTH - GRAM + 1) and state (2) are in one number: runs are the bulk of what is shuffled.
SEAL_BITS, N_BITS, STATE_BITS = 48, 7, 2
RUN_DDL = "anchor long, context long, ord long, seal long, packed long"


def pack(start: np.ndarray, n: np.ndarray, state: np.ndarray) -> np.ndarray:
    return ((start << N_BITS | n) << STATE_BITS) | state


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, n, state)"""
    return packed >> (N_BITS + STATE_BITS), packed >> STATE_BITS & ((1 << N_BITS) - 1), packed & ((1 << STATE_BITS) - 1)


def _digests(data: bytes, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    import xxhash

    view = memoryview(data)
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + k + LENGTH - 1]) for a, k in zip(starts.tolist(), n.tolist(), strict=True)), np.uint64, len(starts)).view(np.int64)


def _sealed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Ids in their order, texts, and a hash of SEAL_BITS that tells apart the texts under one id.

    Texts without an id have a place and a seal of their own, from two hashes.
    """
    picked = docs.select(column(docs, key, "long").alias("doc_id"), F.coalesce(column(docs, text, "string"), F.lit("")).alias("text"))
    drawn = F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(NO_ID))
    return picked.select("doc_id", F.coalesce("doc_id", drawn).alias("ord"), F.pmod(F.xxhash64(F.lit(SEAL_BITS), "text"), F.lit(1 << SEAL_BITS)).alias("seal"), "text")


def common_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors in at least COMMON of a bounded sample of documents: few, whatever the corpus; they only steer the dealing."""
    total = docs.count()
    rate = min(1.0, SAMPLE_DOCS / max(total, 1))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.unique(runs(x.as_py().encode())[0]) for x in batch["text"]]
            anchor, n = np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            many = n > 1 if batch.num_rows > 1 / COMMON else np.ones(len(n), bool)  # what is common is so in most batches
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor[many].view(np.int64)), "n": pa.array(n[many].astype(np.int64))})

    sample = docs.where(F.pmod(F.xxhash64("ord", "seal"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    counted = sample.select("text").mapInArrow(work, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= max(16, int(COMMON * rate * total))).toArrow()
    return np.sort(found["anchor"].to_numpy())


def run_rows(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """A row for each run; equal contexts within a batch keep only their first run open."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for x, o, s in zip(batch["text"], batch["ord"].to_numpy(), batch["seal"].to_numpy(), strict=True):
                data = x.as_py().encode()
                anchor, start, n = runs(data)
                for c, v in zip(cols, (anchor.view(np.int64), _digests(data, start, n), np.full(len(n), o), np.full(len(n), s), start, n), strict=True):
                    c.append(v)
            anchor, context, ord_, seal, start, n = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
            by = np.lexsort((start, ord_, context, anchor))
            same = lambda x: x[by][1:] == x[by][:-1]
            again = np.zeros(len(by), bool)
            again[1:] = same(anchor) & same(context)
            # rows at the very place of a context's first one do not come after it
            first = by[np.maximum.accumulate(np.where(again, 0, np.arange(len(by))))] if len(by) else by
            settled = np.zeros(len(by), bool)
            settled[by] = again & ((ord_[by] != ord_[first]) | (start[by] != start[first]))
            state = np.where(settled, SETTLED, np.where(np.isin(anchor, shared.value), SPREAD, PLAIN))
            # in the order of the documents, where neighbours compress well
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor), "context": pa.array(context), "ord": pa.array(ord_), "seal": pa.array(seal), "packed": pa.array(pack(start, n, state))})

    return docs.select("ord", "seal", "text").mapInArrow(work, RUN_DDL)


def _judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by anchor, context and place: which are settled, and which first runs stay open.

    Rows of an anchor are held back only while it has few contexts; from MOST_CONTEXTS on it is
    spread and passed on at once.
    """
    names = ("ord", "seal", "start", "n", "anchor", "state")
    held: list[tuple] = []
    anchor = context = place = None
    spread = False

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        ways = zip(*rows, strict=True) if rows else ((),) * 6
        return pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, v, t in zip(names, ways, kinds, strict=True)})

    out: list[tuple] = []
    contexts = 0

    def close() -> None:
        if contexts > 1:
            out.extend(held)
        held.clear()

    for batch in batches:
        a, c, ord_, seal = (batch[x].to_numpy() for x in ("anchor", "context", "ord", "seal"))
        start, n, state = unpack(batch["packed"].to_numpy())
        settled = state == SETTLED
        # an anchor's only row, the usual case, needs no look
        lone = np.zeros(len(a), bool)
        if len(a) > 2:
            lone[1:-1] = (a[1:-1] != a[:-2]) & (a[1:-1] != a[2:]) & (state[1:-1] == PLAIN)
        for i in np.flatnonzero(~lone).tolist():
            row = (int(ord_[i]), int(seal[i]), int(start[i]), int(n[i]), int(a[i]))
            if settled[i]:
                out.append((*row, SETTLED))
                continue
            if a[i] != anchor:
                close()
                anchor, context, contexts, spread = a[i], None, 0, False
            if c[i] != context:
                context, place, contexts = c[i], (row[0], row[2]), contexts + 1
            elif place != (row[0], row[2]):
                out.append((*row, SETTLED))
                continue
            if state[i] == SPREAD or spread:
                out.append((*row, SPREAD))
                continue
            held.append((*row, PLAIN))
            if len(held) >= MOST_CONTEXTS:
                spread = True
                out.extend((*r[:5], SPREAD) for r in held)
                held.clear()
        if len(out) >= 1 << 16:
            yield packed(out)
            out = []
    close()
    yield packed(out)


def judged(rows: DataFrame) -> DataFrame:
    """(ord, seal, start, n, anchor, state) of settled and open runs."""
    state = F.col("packed").bitwiseAND((1 << STATE_BITS) - 1)
    deal = F.when(state == PLAIN, F.col("anchor")).otherwise(F.xxhash64("anchor", "context", F.when(state == SETTLED, F.col("ord"))))
    # the start is in the high bits of what is packed
    dealt = rows.repartition(deal).sortWithinPartitions(state == SETTLED, "anchor", "context", "ord", "packed")
    return dealt.mapInArrow(_judged, "ord long, seal long, start int, n int, anchor long, state int")


def contexts_of(docs: DataFrame, open_runs: DataFrame) -> DataFrame:
    """Open runs with the bytes of their strings: (ord, seal, start, n, anchor, state, bytes)."""
    of = open_runs.groupBy("ord", "seal").agg(F.collect_list(F.struct("start", "n", "anchor", "state")).alias("runs"))  # of one text

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for o, s, x, found in zip(batch["ord"].to_pylist(), batch["seal"].to_pylist(), batch["text"], batch["runs"].to_pylist(), strict=True):
                data = x.as_py().encode()
                rows += [(o, s, r["start"], r["n"], r["anchor"], r["state"], data[r["start"] : r["start"] + r["n"] + LENGTH - 1]) for r in {(r["start"], r["n"]): r for r in found}.values()]
            kinds = {"ord": pa.int64(), "seal": pa.int64(), "start": pa.int32(), "n": pa.int32(), "anchor": pa.int64(), "state": pa.int32(), "bytes": pa.binary()}
            ways = zip(*rows, strict=True) if rows else ((),) * 7
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, t), v in zip(kinds.items(), ways, strict=True)})

    return docs.select("ord", "seal", "text").join(of, ["ord", "seal"]).mapInArrow(work, "ord long, seal long, start int, n int, anchor long, state int, bytes binary")


def _ranges(ord_: np.ndarray, seal: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Starts as maximal ranges (ord, seal, start, n)."""
    by = np.lexsort((start, seal, ord_))
    ord_, seal, start = ord_[by], seal[by], start[by]
    new = np.ones(len(by), bool)
    new[1:] = (ord_[1:] != ord_[:-1]) | (seal[1:] != seal[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    last = start[np.append(at[1:], len(by)) - 1] if len(at) else start
    return pa.RecordBatch.from_pydict({"ord": pa.array(ord_[at]), "seal": pa.array(seal[at]), "start": pa.array(start[at].astype(np.int32)), "n": pa.array((last - start[at] + 1).astype(np.int32))})


def later_starts(block: list[tuple]) -> pa.RecordBatch:
    """Of a block's (ord, seal, start, n, bytes): the string starts that have an equal string before them."""
    ord_, seal, start, n = (np.array(x, np.int64) for x in list(zip(*block, strict=True))[:4])
    context, offset, group = equal_strings([r[4] for r in block], n)
    at = start[context] + offset
    by = np.lexsort((at, ord_[context], group))
    context, at, group = context[by], at[by], group[by]
    head = np.ones(len(by), bool)
    head[1:] = group[1:] != group[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
    later = (ord_[context] != ord_[context][first]) | (at != at[first])
    return _ranges(ord_[context][later], seal[context][later], at[later])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole anchors are joined to blocks of about BLOCK_BYTES."""
    block: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        anchors = batch["anchor"].to_pylist()
        for row in zip(anchors, *(batch[c].to_pylist() for c in ("ord", "seal", "start", "n", "bytes")), strict=True):
            if row[0] != last and size >= BLOCK_BYTES:
                yield later_starts(block)
                block, size = [], 0
            last = row[0]
            block.append(row[1:])
            size += len(row[5])
    if block:
        yield later_starts(block)


def spread_starts(contexts: DataFrame) -> DataFrame:
    """The later starts of common anchors' contexts, compared string by string over all tasks.

    Strings that a batch has before are settled there, so a common one sends a row per batch.
    """
    import xxhash

    def strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts: dict[bytes, tuple[int, int, int]] = {}
            later: list[tuple[int, int, int]] = []
            for o, s, at, n, data in zip(*(batch[c].to_pylist() for c in ("ord", "seal", "start", "n", "bytes")), strict=True):
                for i in range(n):
                    key, place = xxhash.xxh3_128_digest(data[i : i + LENGTH]), (o, at + i, s)
                    held = firsts.get(key)
                    if held is None:
                        firsts[key] = place
                    elif place[:2] == held[:2]:  # one place, in texts under one id
                        firsts[key + b"%d" % len(firsts)] = place
                    else:
                        firsts[key], place = min(held, place), max(held, place)
                        later.append(place)
            ends = np.array(later, np.int64).reshape(-1, 3)
            ranges = _ranges(ends[:, 0], ends[:, 2], ends[:, 1])
            yield pa.RecordBatch.from_arrays([pa.nulls(ranges.num_rows, pa.binary()), *ranges.columns], names=["string", *ranges.schema.names])
            o, at, s = zip(*firsts.values(), strict=True) if firsts else ((), (), ())
            yield pa.RecordBatch.from_pydict({"string": pa.array([k[:16] for k in firsts], pa.binary()), "ord": pa.array(o, pa.int64()), "seal": pa.array(s, pa.int64()), "start": pa.array(at, pa.int32()), "n": pa.array([1] * len(o), pa.int32())})

    each = cut(contexts.mapInArrow(strings, "string binary, ord long, seal long, start int, n int"))
    firsts = each.where("string is not null").groupBy("string").agg(F.min(F.struct("ord", "start")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    later = each.join(firsts, "string").where((F.col("ord") != F.col("first.ord")) | (F.col("start") != F.col("first.start")))
    return each.where("string is null").drop("string").union(later.select("ord", "seal", "start", "n"))


def remove(docs: DataFrame, found: DataFrame, keep_text: bool = False) -> DataFrame:
    """Takes the strings at the found starts out of their texts: digests, and the rest itself if asked for."""
    of = found.groupBy("ord", "seal").agg(F.collect_list(F.struct("start", "n")).alias("found"))  # of one text

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, spans, digests, rest = [], [], [], [], []
            for x, ranges in zip(batch["text"], batch["found"].to_pylist(), strict=True):
                data = x.as_py().encode()
                parts, at, removed, n = [], 0, 0, 0
                for r in sorted(ranges or [], key=lambda r: r["start"]):
                    start, end = r["start"], r["start"] + r["n"] + LENGTH - 1
                    if start > at or not n:
                        parts.append(data[at:start])
                        n, removed, at = n + 1, removed + end - start, end
                    elif end > at:
                        removed, at = removed + end - at, end
                kept = b"".join([*parts, data[at:]])
                sizes.append(len(data))
                gone.append(removed)
                spans.append(n)
                digests.append(hashlib.sha256(kept).hexdigest())
                rest.append(kept.decode("utf-8", "replace") if keep_text else None)
            out = {"doc_id": batch["doc_id"], "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            yield pa.RecordBatch.from_pydict(out | ({"kept": pa.array(rest, pa.string())} if keep_text else {}))

    return docs.join(of, ["ord", "seal"], "left").select("doc_id", "text", "found").mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row a document."""
    sealed = _sealed(docs, key, text)
    state = settled(judged(run_rows(sealed, common_anchors(sealed))))
    contexts = contexts_of(sealed, state.where(F.col("state") != SETTLED))
    dealt = contexts.withColumn("deal", F.when(F.col("state") == PLAIN, F.col("anchor")).otherwise(F.xxhash64("seal", "start"))).repartition("deal")
    open_ = settled(dealt.drop("deal"))
    plain = open_.where(F.col("state") == PLAIN).sortWithinPartitions("anchor").mapInArrow(_blocks, "ord long, seal long, start int, n int")
    found = state.where(F.col("state") == SETTLED).select("ord", "seal", "start", "n").union(plain).union(spread_starts(open_.where(F.col("state") == SPREAD)))
    return remove(sealed, found, keep_text)


def op10_repeated_spans(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
