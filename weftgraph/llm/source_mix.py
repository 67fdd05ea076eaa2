"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 3).

Every source's documents lie, in a seeded order, on shards of similar size, and each shard's
words form blocks of BLOCK words. The highest quotients votes / (2k + 1) give whole numbers
of blocks first to sources, by their targets, and then to each source's shards, by their
sizes. Within a shard a seeded rotation picks that many blocks evenly; up to twice the
shard's blocks can be asked for, and each block is then taken once or twice. A document's
share is what the picked blocks cover of its words, so nothing is listed block by block.

Defined cases: a null or empty text has size 0 and is never taken; very long texts cover
many blocks; the null source is a source of its own, last in order; repeated rows are
documents of their own; ties between quotients go to the smaller source or shard; an empty
table gives an empty result; other columns are ignored. Reruns agree: all order comes from
hashes of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import column, cut, fresh, table

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 16
#: Words and rows of a shard, about: a shard's rows are ordered within one task.
SHARD_WORDS, SHARD_ROWS = 1 << 21, 1 << 18
#: Up to so many sources, their few numbers each (some 100 bytes) are sent to every task; above, documents join them by shuffle.
SENT_SOURCES = 100_000
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row a source.

    What all the sources share rises as water does: sources in the order in which they reach
    ``most`` times their size are full, the others hold in proportion to their weights.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    weighed = sources.withColumn("weight", F.get(cycle, ((F.row_number().over(place) - 1) % len(weights)).cast("int"))).withColumn("full", most * F.col("source_size"))
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = weighed.withColumn("level", level)
    # the first source that stays below its bound sets the level of all from there on
    at = F.min(F.when(F.col("full") / F.col("weight") > F.col("level"), F.struct(F.col("full") / F.col("weight"), "level"))).over(everything)["level"]
    return leveled.withColumn("target", F.coalesce(F.least(F.col("full"), F.col("weight") * at), F.col("full")).cast("double")).select("source", "source_size", "target")


def apportion(parties: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``blocks``: Sainte-Laguë's share of each group's ``seats`` by ``votes``, at most ``bound``.

    A party's share differs from its exact quota by at most half of (1 + its size against the
    mean party), so only the quotients within that distance compete: a few for each party,
    instead of one for each block.
    """
    of = Window.partitionBy(*[F.col(g) for g in group]) if group else Window.partitionBy()
    quota = F.col("votes") * F.col("seats") / F.sum("votes").over(of)
    slack = F.lit(0.5) + F.col("votes") * F.count(F.lit(1)).over(of) / F.sum("votes").over(of) / 2
    voting = parties.where("votes > 0").withColumn("sure", F.greatest(F.lit(0), F.floor(quota - slack) - 1).cast("long")).withColumn("last", (F.ceil(quota + slack) + 1).cast("long"))
    offers = voting.withColumn("open", F.col("seats") - F.sum("sure").over(of)).withColumn("k", F.explode(F.expr("sequence(sure, last)")))
    best = Window.partitionBy(*[F.col(g) for g in group]).orderBy(F.desc(F.col("votes") / (2 * F.col("k") + 1)), *order, "k")
    own = parties.columns
    return (
        offers.withColumn("nth", F.row_number().over(best)).groupBy(*own, "sure").agg(F.count_if(F.col("nth") <= F.col("open")).alias("more"))
        .select(*own, F.least(F.col("sure") + F.col("more"), F.col("bound")).cast("long").alias("blocks"))
    )


def picked_before(word: Column, blocks: Column, quota: Column, turn: Column) -> Column:
    """How many words the picked blocks have in the shard's first ``word`` words.

    Block b is picked as often as (b + turn) * quota / blocks passes a whole number.
    """
    block = F.floor(word / BLOCK).cast("long")
    passed = lambda b: ((b + turn) * quota - (b + turn) * quota % blocks) / blocks  # noqa: E731  whole division
    start = ((turn * quota) - (turn * quota) % blocks) / blocks
    full = (passed(block) - start).cast("long")
    this = (passed(block + 1) - passed(block)).cast("long")
    return full * BLOCK + this * (word - block * BLOCK)


def mix(docs: DataFrame, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row a document."""
    sized = cut(
        docs.select(column(docs, key, "long").alias("doc_id"), column(docs, source, "string").alias("source"), words(column(docs, text, "string")).alias("size"))
        .withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    )
    totals = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    # texts without words still are rows, so shards are counted by both
    ways = F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("rows") / SHARD_ROWS)).cast("long")
    aimed = cut(targets(totals.drop("rows")).join(totals.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    named = aimed.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    seats = named.select("name", F.col("target").alias("votes"), F.round(F.sum("target").over(Window.partitionBy()) / BLOCK).cast("long").alias("seats"), (2 * F.ceil(F.col("source_size") / BLOCK)).cast("long").alias("bound"))
    sources = apportion(seats, [], ["name"]).select("name", F.col("blocks").alias("seats"))
    of = named.select("name", "source_size", "target", F.greatest(ways, F.lit(1).cast("long")).alias("ways"))
    of = F.broadcast(of) if aimed.count() <= SENT_SOURCES else of
    # dealt by shard, not left where a join by source put them: one source may have a third of all rows
    dealt = (
        sized.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).join(of, "name")
        .withColumn("shard", F.pmod(F.conv(F.substring("draw", 1, 12), 16, 10).cast("long"), F.col("ways")))
        .repartition("name", "shard")
    )
    shards = dealt.groupBy("name", "shard").agg(F.sum("size").alias("votes")).join(sources, "name")
    quotas = apportion(shards.withColumn("bound", (2 * F.ceil(F.col("votes") / BLOCK)).cast("long")), ["name"], ["shard"])
    within = Window.partitionBy("name", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum("size").over(within)).join(quotas.select("name", "shard", F.col("votes").alias("shard_size"), F.col("blocks").alias("quota")), ["name", "shard"], "left")
    blocks = F.ceil(F.col("shard_size") / BLOCK).cast("long")
    turn = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"turn{seed}"), "name", F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long"), blocks)
    up_to = lambda word: picked_before(word, blocks, F.col("quota"), turn)
    taken = F.coalesce(up_to(F.col("end")) - up_to(F.col("end") - F.col("size")), F.lit(0)).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def mixed(docs: DataFrame, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, 0 to 2 times.

    What the mix takes of a document is rounded to whole copies by a draw from its id, so
    that the sources' words stay at their targets on average. Any other columns pass through.
    """
    facts = [F.col("doc_id"), F.col("source"), F.col("size")]
    rates = mix(docs, seed, key, text, source).where("size > 0").groupBy(*facts).agg((F.sum("taken") / F.sum("size")).alias("rate"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"copies{seed}"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    id_, from_, size, times = (fresh(docs, n) for n in ("mix_id", "mix_source", "mix_size", "copies"))
    copies = rates.select(F.col("doc_id").alias(id_), F.col("source").alias(from_), F.col("size").alias(size), F.floor(F.col("rate") + draw).cast("int").alias(times)).where(F.col(times) > 0)
    same = docs[key].cast("long").eqNullSafe(copies[id_]) & docs[source].eqNullSafe(copies[from_]) & (words(docs[text]) == copies[size])
    taken = docs.join(copies, same).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return taken.select(*docs.columns)


def op3_source_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


# The same shares by highest quotients, block by block. Sources here have at most one shard each,
# which holds below SHARD_WORDS words a source.
OP3_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1)::INTEGER % 3 + 1]::DOUBLE AS weight FROM sized GROUP BY source
), leveled AS (
  SELECT *, {MOST} * source_size AS bound,
    ({SHARE} * sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WINDOW o AS (ORDER BY {MOST} * source_size / weight, source NULLS LAST)
), aimed AS (
  SELECT source, source_size, least(bound, weight * coalesce((SELECT min_by(level, bound / weight) FROM leveled WHERE bound / weight > level), 1e300))::DOUBLE AS target FROM leveled
), seats AS (SELECT round(sum(target) / {BLOCK})::BIGINT AS n FROM aimed),
offers AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, CASE WHEN source IS NULL THEN '' ELSE '=' || source END, k) AS nth
  FROM aimed, unnest(range((target / {BLOCK})::BIGINT + 30)) AS t(k) WHERE target > 0
), quotas AS (
  SELECT a.source, a.source_size, a.target, least(coalesce(w.n, 0), 2 * ceil(a.source_size / {BLOCK}))::BIGINT AS quota, ceil(a.source_size / {BLOCK})::BIGINT AS blocks,
    ('0x' || substr(md5('turn0:' || CASE WHEN a.source IS NULL THEN '' ELSE '=' || a.source END || ':0'), 1, 8))::BIGINT AS draw
  FROM aimed a LEFT JOIN (SELECT source, count(*) AS n FROM offers WHERE nth <= (SELECT n FROM seats) GROUP BY source) w ON a.source IS NOT DISTINCT FROM w.source
), placed AS (
  SELECT s.doc_id, s.source, s.size, q.source_size, q.target, q.quota, q.blocks, CASE WHEN q.blocks > 0 THEN q.draw % q.blocks END AS turn,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
), counted AS (
  SELECT *, ((upto // {BLOCK} + turn) * quota // blocks - turn * quota // blocks) * {BLOCK} + ((upto // {BLOCK} + 1 + turn) * quota // blocks - (upto // {BLOCK} + turn) * quota // blocks) * (upto % {BLOCK})
    - ((upto - size) // {BLOCK} + turn) * quota // blocks * {BLOCK} + turn * quota // blocks * {BLOCK}
    - (((upto - size) // {BLOCK} + 1 + turn) * quota // blocks - ((upto - size) // {BLOCK} + turn) * quota // blocks) * ((upto - size) % {BLOCK}) AS got
  FROM placed
)
SELECT doc_id, size, source_size, target, coalesce(got, 0)::BIGINT AS taken, source FROM counted
"""
