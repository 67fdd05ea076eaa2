"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 4).

Distinct fingerprints emit themselves and every variant within half the linking radius. Two
fingerprints within the radius have a variant in common, and those that share a variant
are within the radius of each other, so linking each to the smallest of its variant keeps
every connection without listing pairs; each link is verified before use. Components are
found over distinct fingerprints by alternating star joins.

Defined cases: a null, empty or blank text has no shingle and fingerprint zero, which links
like any other; fewer words than a shingle's count as one shingle; very long texts are
worked through whole; repeated rows share a fingerprint and so a component; a null id is
never the smallest of a component unless all are null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import batches_of, column, cut, settled, table

BITS = 64
SEED = 42
#: Hashes whose bits are unpacked at once.
PIECE = 1 << 16
#: A stage's near duplicates: words of a shingle, least similarity (also as a fraction).
SHINGLE, SIMILARITY = 5, 0.8
OF, IN = 4, 5
#: A prefix has one shingle in so many more than it needs, and two prefixes then share as many more.
EXTRA = 20
SHINGLE_PRINT = 3
#: Texts of an Arrow batch worked through at once: a task's memory holds their shingles, not the whole batch's.
TEXTS = 256
#: Up to so many texts to be read again, their names (some 50 bytes each) are sent to every task; more are joined by shuffle.
SENT_NODES = 400_000
#: Texts sampled for the order of shingles, and how many common ones that order knows; both steer work, never a result.
ORDER_TEXTS, ORDER_SHINGLES = 10_000, 1 << 19
#: Rounds in which texts without enough shingles that others hold are dropped; they steer work, never a result.
ROUNDS = 2


def shingle_hashes(text: str, n: int) -> Iterator[np.ndarray]:
    """Hashes of the n-word shingles, in pieces; words are split at ASCII white space and A-Z lower-cased."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= n:
        if words:
            yield np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1].tolist()
    ends = ends[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for low in range(0, len(starts), PIECE):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[low : low + PIECE], ends[low : low + PIECE], strict=True)], np.uint64)


def fingerprint(text: str | None, n: int = 3) -> int:
    """Bit b is set if it is set in over half of the shingles' hashes."""
    total, counts = 0, np.zeros(BITS, np.int64)
    for h in shingle_hashes(text or "", n):
        total += len(h)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print): fingerprints as signed longs."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch["text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "print": pa.array(prints.view(np.int64))})

    picked = docs.select(column(docs, key, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    return picked.mapInArrow(work, "doc_id long, print long")


def flips(radius: int, bits: int = BITS) -> list[int]:
    """What turns a fingerprint into each variant within ``radius`` bits, as signed longs."""
    masks = [sum(1 << b for b in at) for r in range(radius + 1) for at in combinations(range(bits), r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): connected as the pairs of distinct ``print`` within ``radius`` bits are; radius must be even.

    A variant's holders lie within half the radius of it, so they are few whatever the input:
    at most as many as there are flips.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    balls = prints.select("print", F.explode(F.lit(flips(radius // 2))).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("variant"))
    met = balls.withColumn("least", F.min("print").over(Window.partitionBy("variant"))).where("least <> print")
    verified = met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("least"))) <= radius)
    return verified.select(F.col("least").alias("a"), F.col("print").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component.

    Rounds of large and small stars (Kiverris et al.) until nothing changes; each round's
    edges are checkpointed, and a hub's neighbours are spread by the neighbours themselves.
    """
    now = cut(edges.select("a", "b"))
    seen = None
    while True:
        # large star: each node links its larger neighbours to the least of its neighbourhood
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        # small star: each node links itself and its smaller neighbours to the least of them
        least = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        small = large.join(least, large["b"] == least["n"]).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        now = settled(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row a document."""
    printed = cut(fingerprints(docs, shingle, key, text))
    firsts = cut(printed.groupBy("print").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("print"), radius))
    rooted = firsts.join(roots, F.col("print") == F.col("node"), "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("print", "component_id")
    return printed.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# ---- one document of each group, for a stage that removes near duplicates ----


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of the SHINGLE-word shingles, ascending."""
    hashes = [*shingle_hashes(text or "", SHINGLE)]
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)


@lru_cache(maxsize=256)
def set_of(text: str | None) -> np.ndarray:
    """The same, kept for texts that are asked for again."""
    return shingle_set(text)


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most TEXTS at once."""
    for batch in batches:
        for low in range(0, batch.num_rows, TEXTS):
            yield batch.slice(low, TEXTS)


def common_shingles(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, ascending, and in how many of them."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, n = np.unique(np.concatenate([shingle_set(x.as_py()) for x in batch["text"]]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    share = min(1.0, ORDER_TEXTS / max(1, docs.count()))
    texts = docs.select(column(docs, text, "string").alias("text")).withColumn("seal", F.xxhash64("text")).where(F.pmod("seal", F.lit(1 << 30)) < share * (1 << 30))
    counts = texts.groupBy("seal").agg(F.first("text").alias("text")).select("text").mapInArrow(work, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = counts.where("n > 2").orderBy(F.desc("n"), "shingle").limit(ORDER_SHINGLES).toArrow()
    h, n = found["shingle"].to_numpy().view(np.uint64), found["n"].to_numpy()
    at = np.argsort(h)
    return h[at], n[at]


def prefix(shingles: np.ndarray, common: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The first shingles in the order rare to common, then by hash, in two parts: not common and common; and how common they are together.

    Two sets SIMILARITY alike have 1 + n // EXTRA of these in common, n the smaller one's size:
    they share at least OF / IN of each, so of the shared ones no more can lie behind either prefix.
    """
    size = len(shingles) + OF * len(shingles) // -IN + 1 + len(shingles) // EXTRA if len(shingles) else 0
    if not len(common):
        return shingles[:size], shingles[:0], 0
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    known = np.where(common[at] == shingles, often[at], 0)
    first = np.argsort(known, kind="stable")[:size]
    hot = known[first] > 0
    return shingles[first[~hot]], shingles[first[hot]], int(np.log2(1 + known[first]).sum())


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, seal, exact, print, n, weight, prefix, hot) of each text, words as above.

    ``seal`` names the text and ``exact`` its word sequence, ``print`` is the fingerprint of
    SHINGLE_PRINT-word shingles, ``n`` counts the distinct SHINGLE-word shingles. The prefix's
    shingles are in two arrays: those that the sample shows to be common are ``hot``; ``weight``
    is larger for a text of which more and more common ones are.
    """
    import xxhash

    order = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text))

    def one(text: str | None) -> tuple[bytes, int, int, int, np.ndarray, np.ndarray]:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        shingles = shingle_set(text)
        rare, hot, weight = prefix(shingles, *order.value)
        return xxhash.xxh3_128_digest(b" ".join(words)), fingerprint(text, SHINGLE_PRINT), len(shingles), weight, rare.view(np.int64), hot.view(np.int64)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            exact, prints, n, weight, rare, hot = zip(*map(one, batch["text"].to_pylist()), strict=True)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "seal": batch["seal"], "exact": pa.array(exact, pa.binary()), "print": pa.array(np.array(prints, np.uint64).view(np.int64)),
                "n": pa.array(n, pa.int32()), "weight": pa.array(weight, pa.int32()), "prefix": pa.array(rare, pa.list_(pa.int64())), "hot": pa.array(hot, pa.list_(pa.int64())),
            })

    picked = docs.select(column(docs, key, "long").alias("doc_id"), column(docs, text, "string").alias("text")).withColumn("seal", F.xxhash64("text"))
    return picked.mapInArrow(work, "doc_id long, seal long, exact binary, print long, n int, weight int, prefix array<long>, hot array<long>")


def compared(pairs: DataFrame, texts: DataFrame, docs: DataFrame, key: str, text: str, keep_rest: bool = False) -> DataFrame:
    """(a, b, alike, both, rest) of the (a, b) of ``pairs``, by all shingles of both texts.

    ``both`` counts the shingles that they share, ``rest`` has those of b only if asked for.
    """
    ends = settled(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    wanted = texts.join(ends, "node").select("node", "seal", F.col("doc_id").alias("id"))
    wanted = F.broadcast(wanted) if ends.count() <= SENT_NODES else wanted
    named = docs.select(column(docs, key, "long").alias("doc_id"), column(docs, text, "string").alias("text")).withColumn("seal", F.xxhash64("text"))
    # by id and text, so that of many copies one row meets it; rows equal in both are one
    read = settled(named.join(wanted, (named["seal"] == wanted["seal"]) & named["doc_id"].eqNullSafe(wanted["id"])).select("node", "text").dropDuplicates(["node"]))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ok, shared, rest = [], [], []
            for x, y in zip(batch["text_a"], batch["text_b"], strict=True):
                x, y = set_of(x.as_py()), set_of(y.as_py())
                there = np.isin(y, x, assume_unique=True)
                both = int(np.count_nonzero(there))
                ok.append(both * IN >= (len(x) + len(y) - both) * OF)
                shared.append(both)
                rest.append(y[~there].view(np.int64) if keep_rest else None)
            yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"], "alike": pa.array(ok, pa.bool_()), "both": pa.array(shared, pa.int32()), "rest": pa.array(rest, pa.list_(pa.int64()))})
        set_of.cache_clear()  # a worker outlives its task

    for end in ("a", "b"):
        pairs = pairs.join(read.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")), end)
    return settled(pairs.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long, alike boolean, both int, rest array<long>"))


def enough(n: Column) -> Column:
    """How many shingles of their prefixes two alike texts share at least, ``n`` the smaller one's shingles."""
    return 1 + F.floor(n / EXTRA)


def needed(n: Column, m: Column) -> Column:
    """How many shingles two alike texts of ``n`` and ``m`` share at least."""
    return F.ceil((n + m) * OF / (OF + IN) - 1e-6)


def behind(n: Column) -> Column:
    """How many shingles lie behind a prefix."""
    return F.ceil(n * OF / IN - 1e-6) - 1 - F.floor(n / EXTRA)


def shared_prefixes(texts: DataFrame) -> DataFrame:
    """(shingle, node, n, top) of the prefixes' shingles that several texts hold; ``top`` is the heaviest of these, with its weight."""
    of = lambda c: texts.select("node", "n", "weight", F.explode(c).alias("shingle"))
    bucket, heavy = Window.partitionBy("shingle"), F.max(F.struct("weight", "node"))
    rare = of("prefix").withColumn("top", heavy.over(bucket)).withColumn("low", F.min("node").over(bucket)).withColumn("high", F.max("node").over(bucket))
    # a common shingle's holders may be a third of all texts: they are counted before the shuffle and never meet in one task
    hot = of("hot")
    hot = hot.join(hot.groupBy("shingle").agg(heavy.alias("top"), F.min("node").alias("low"), F.max("node").alias("high")), "shingle")
    names = ["shingle", "node", "n", "top", "low", "high"]
    return rare.select(*names).union(hot.select(*names)).where("low <> high").drop("low", "high")


def first_partners(shared: DataFrame) -> DataFrame:
    """(a, b): each text b and one text a of its buckets, by (node, n, top): the representative ``top`` of each of its buckets.

    Of those with which a text shares at least half as much as with any, and enough, the
    heaviest is tried: near copies of one text then all try that text, and not each other.
    """
    met = shared.where("top.node <> node").repartition("node")
    counts = met.groupBy("node", "top").agg(F.count("*").alias("k"), F.first("n").alias("n")).where(F.col("k") * 3 >= enough(F.col("n")))
    most = counts.withColumn("most", F.max("k").over(Window.partitionBy("node"))).where("k * 2 >= most")  # a text has no more than its shingles
    return most.groupBy(F.col("node").alias("b")).agg(F.max("top")["node"].alias("a")).select("a", "b")


def fitting(n: Column) -> Column:
    """How many shingles the smallest text alike to one of ``n`` has."""
    return F.ceil(n * OF / IN - 1e-6)


def fits(n: Column, m: Column) -> Column:
    """Whether texts of ``n`` and ``m`` shingles can be alike."""
    return F.least(n, m) * IN >= F.greatest(n, m) * OF


def live(rows: DataFrame) -> DataFrame:
    """Those of (shingle, within, side, node, root, least, ...) that may be of a link, and ``most``: how many its node has.

    Links are between nodes of one ``within``, of different sides and groups. Linked to any
    other, a node shares at least ``least`` shingles: one with fewer that another side and group
    hold has no link, and what it held may then be no other's. Further rounds change work only.
    """
    for _ in range(ROUNDS):
        several = rows.groupBy("shingle", "within").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("side").alias("x"), F.max("side").alias("y")).where("low <> high and x <> y").select("shingle", "within")
        rows = rows.drop("most").join(several, ["shingle", "within"], "left_semi")
        held = rows.groupBy("within", "node").agg(F.count("*").alias("most"), F.first("least").alias("#")).where(F.col("most") >= F.col("#")).drop("#")
        rows = settled(rows.join(held, ["within", "node"]))
    return rows


def sides_met(rows: DataFrame) -> DataFrame:
    """(shingle, within, side, side_b, left) in which two sides of the rows of ``live`` meet that may have a link; ``left`` is how many shingles such a link may share besides.

    A side leaves out its most common shingles, one less than any link of it shares, and two
    sides meet only if sizes of their texts fit.
    """
    of = ["within", "side"]
    sizes = rows.groupBy(*of).agg(F.min("n").alias("small"), F.max("n").alias("large"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("least").alias("least"))
    sides = rows.select("shingle", *of).distinct()
    held = sides.join(sides.groupBy("shingle", "within").agg(F.count("*").alias("holders")), ["shingle", "within"]).join(sizes, of)
    common = Window.partitionBy(*of).orderBy(F.desc("holders"), F.desc("shingle"))
    rare = settled(held.withColumn("place", F.row_number().over(common)).where("place >= least").drop("place", "holders"))
    other = rare.select("shingle", "within", *[F.col(c).alias(f"{c}_b") for c in ("side", "small", "large", "low", "high", "least")])
    near = (F.col("large") * IN >= F.col("small_b") * OF) & (F.col("large_b") * IN >= F.col("small") * OF)
    apart = F.least("low", "low_b") != F.greatest("high", "high_b")
    # of two texts that fit, the smaller one has no less
    smaller = F.greatest(F.least("small", "small_b"), fitting(F.greatest("small", "small_b")))
    met = settled(rare.join(other, ["shingle", "within"]).where((F.col("side") < F.col("side_b")) & near & apart).select("shingle", *of, "side_b", (F.greatest("least", "least_b") - 1).alias("left"), smaller.alias("n")))
    both = [*of, "side_b"]
    sharing = met.groupBy(*both).agg(F.count("*").alias("k"), F.first("left").alias("left"), F.first("n").alias("n")).where(F.col("k") >= enough(F.col("n")) - F.col("left")).select(*both)
    return met.join(sharing, both, "left_semi").select("shingle", *both, "left")


def pairs_left(shared: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b) that may be alike and are in no one group yet, but for those that one common partner settles.

    ``placed`` has (node, root, of, both): of is the text that a node was tried with (its own
    number if none) and both what they share. Two texts tried with the same one share no more
    of its shingles than ``both``; whether they share others, ``pairs_by_rest`` tells.
    """
    n, m = F.col("n"), F.col("n_b")
    least = needed(n, m) - F.greatest(behind(n), behind(m))
    rows = shared.select("shingle", "node", "n").join(placed, "node").withColumn("least", enough(fitting(n)))
    across = live(rows.select("shingle", F.lit(0).alias("within"), F.col("of").alias("side"), "node", "n", "root", "least"))
    other = across.select("shingle", "within", *[F.col(c).alias(f"{c}_b") for c in ("side", "node", "n", "root", "most")])
    met = sides_met(across).join(across, ["shingle", "within", "side"]).join(other, ["shingle", "within", "side_b"])
    met = met.where((F.col("root") != F.col("root_b")) & fits(n, m) & (least <= F.least("most", "most_b"))).withColumn("least", least - F.col("left"))
    crossing = met.groupBy(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).agg(F.count("*").alias("k"), F.first("least").alias("least")).where("k >= least").select("a", "b")
    # tried with one text longer than they are, two texts may share enough of its shingles alone
    mixed = placed.groupBy("of").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("of")
    inside = rows.join(mixed, "of", "left_semi").where(needed(n, fitting(n)) <= F.col("both"))
    by_one = needed(n, m) <= F.least("both", "both_b")
    return crossing.union(pairs_within(rarest(inside), F.when(by_one, least)))


def rarest(rows: DataFrame) -> DataFrame:
    """(shingle, of, node, n, root, both, behind, most): of each node's shingles what every link to another group of texts tried with the same one shows a part of.

    ``least`` is how many of these shingles any link of a node shares. Of those that may be of
    a link, ``most`` in number, the ones with the fewest holders come first: all but
    ``least - 1`` hold one of any link's, and ``behind`` counts those. Common shingles are then
    left out, and a pair meets in few of what it shares.
    """
    held = live(rows.select("shingle", F.col("of").alias("within"), F.col("root").alias("side"), "node", "n", "root", "both", "least"))
    held = held.join(held.groupBy("shingle", "within").agg(F.count("*").alias("holders")), ["shingle", "within"])
    ranked = held.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("holders", "shingle"))).where("place <= most - least + 1")
    return ranked.select("shingle", F.col("within").alias("of"), "node", "n", "root", "both", (F.col("least") - 1).alias("behind"), "most")


def pairs_within(rows: DataFrame, least: Column) -> DataFrame:
    """(a, b) of different groups, tried with the same text, that may share ``least`` of the shingles of ``rows``; without a ``least`` they share too few."""
    rows = settled(rows)
    # of two groups, one is not the largest: that group's texts don't meet each other
    sizes = rows.groupBy("of", "root").agg(F.count("*").alias("size")).groupBy("of").agg(F.max(F.struct("size", "root"))["root"].alias("main"))
    first = rows.join(sizes, "of").where("root <> main")
    other = rows.select("shingle", "of", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "root", "both", "behind", "most")])
    once = (F.col("root_b") == F.col("main")) | (F.col("node") < F.col("node_b"))
    met = first.join(other, ["shingle", "of"]).where(once & (F.col("root") != F.col("root_b")) & fits(F.col("n"), F.col("n_b")) & (least <= F.least("most", "most_b")))
    counts = met.groupBy(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).agg(F.count("*").alias("k"), F.first(least - F.greatest("behind", "behind_b")).alias("least"))
    return counts.where("k >= least").select("a", "b")


def rest_prefixes(rest: DataFrame, placed: DataFrame) -> DataFrame:
    """The ``rarest`` of each node's ``rest``: linked to any text of fitting size, a node shares at least ``least`` of it."""
    rows = rest.select("shingle", "of", "node", "n").join(placed.select("node", "root", "both"), "node")
    return rarest(rows.withColumn("least", F.greatest(F.lit(1), needed(F.col("n"), fitting(F.col("n"))) - F.col("both"))))


def pairs_by_rest(rest: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b) tried with the same text that may share enough of what it does not have; ``rest`` has (shingle, of, node, n)."""
    return pairs_within(rest_prefixes(rest, placed), needed(F.col("n"), F.col("n_b")) - F.least("both", "both_b"))


def joined_groups(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The (node, root) of ``roots`` with further links."""
    return links_of(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a <> b").union(links))


def links_of(edges: DataFrame) -> DataFrame:
    return components(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, doc_id, seal, root): each distinct word sequence, its row with the smallest id, and its group.

    Texts are linked if their fingerprints are (as in ``near_duplicates``), or if their shingles
    are SIMILARITY alike. Texts so alike share shingles of their prefixes. Each text is first
    tried with one representative. Two texts tried with the same one are then only tried if
    they share enough of what that one does not have, after one representative for these
    shingles; all other pairs that share enough of their prefixes and are not in one group
    yet are tried, so that groups come out as from all pairs.
    """
    found = described(docs, key, text).groupBy("exact").agg(F.min_by(F.struct("doc_id", "seal", "print", "n", "weight", "prefix", "hot"), F.struct(F.col("doc_id").isNull(), "doc_id", "seal")).alias("x"))
    texts = settled(found.select(F.monotonically_increasing_id().alias("node"), "x.*"))
    balls = texts.select("node", "print", F.explode(F.lit(flips(1))).alias("flip")).select("node", F.col("print").bitwiseXOR(F.col("flip")).alias("variant"))
    same = settled(balls.withColumn("a", F.min("node").over(Window.partitionBy("variant"))).where("a <> node").select("a", F.col("node").alias("b")).distinct())
    shared = settled(shared_prefixes(texts))
    tries = settled(first_partners(shared))
    tried = compared(tries, texts, docs, key, text, keep_rest=True)
    roots = links_of(same.union(tried.where("alike").select("a", "b")))

    def places(roots: DataFrame) -> DataFrame:
        of = tried.select(F.col("b").alias("node"), F.col("a").alias("of"), "both")
        own = texts.select("node", "n").join(of, "node", "left").join(roots, "node", "left")
        return own.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("of", "node").alias("of"), F.coalesce("both", "n").alias("both"))

    placed = settled(places(roots))
    mixed = placed.groupBy("of").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("of")
    sized = texts.select(F.col("node").alias("b"), "n")
    rest = tried.join(mixed, tried["a"] == mixed["of"], "left_semi").join(sized, "b").select(F.explode("rest").alias("shingle"), F.col("a").alias("of"), F.col("b").alias("node"), "n")
    rest = settled(rest.join(rest.groupBy("shingle", "of").agg(F.count("*").alias("holders")).where("holders > 1"), ["shingle", "of"]))
    weighed = rest.join(rest.groupBy("node").agg(F.sum(F.log2("holders")).alias("weight")), "node")
    tops = weighed.groupBy("shingle", "of").agg(F.max(F.struct("weight", "node")).alias("top"))
    seconds = settled(first_partners(rest.join(tops, ["shingle", "of"]).select("node", "n", "top")))
    linked = compared(seconds, texts, docs, key, text).where("alike").select("a", "b")
    roots = joined_groups(roots, linked)
    placed = settled(places(roots))
    left = settled(pairs_left(shared, placed).union(pairs_by_rest(rest, placed)).distinct())
    linked = compared(left, texts, docs, key, text).where("alike").select("a", "b")
    if not linked.isEmpty():
        roots = joined_groups(roots, linked)
    return texts.select("node", "doc_id", "seal").join(roots, "node", "left").select("node", "doc_id", "seal", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the one with the smallest id; rows of one id and text are copies."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "seal")
    with batches_of(docs.sparkSession, TEXTS):
        groups = grouped(docs, key, text)
    kept = groups.groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias("kept#id"), F.col("x.seal").alias("kept#seal"))
    # one shuffle of the texts serves both the join and the dropping of copies; a null id is told from others by "kept#none"
    named = lambda df, i: df.withColumn("kept#none", F.col(i).isNull()).withColumn("kept#id", F.coalesce(F.col(i).cast("long"), F.lit(0)))
    names = ["kept#seal", "kept#id", "kept#none"]
    placed = named(docs.withColumn("kept#seal", F.xxhash64(column(docs, text, "string"))), key)
    return placed.join(named(kept, "kept#id"), names).dropDuplicates(names).select(*docs.columns)


def op4_simhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
