"""Secret scans with ownership frequency (operator 6).

Three base patterns find secrets in each text. Further patterns give only candidates: the
hashes of all candidate values are counted over the whole corpus by distinct owners
(``source``) and distinct repositories (``doc_id``). A value that several owners hold is a
copied example; one that at most COPIED_OWNERS hold looks live, in however many repositories;
their number is told beside it. Candidates of
the further patterns become spans only if they look live; base spans always stay and are
counted as live or copied.

Defined cases: a null text counts as empty and has no spans; very long texts are scanned
whole; repeated rows are scanned each and count as one repository; a null owner or id counts
as an owner or repository of its own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import column, cut, fresh, table

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE = ("assign", "access", "hex")

# Further candidates: a known prefix, a signed token of three parts, a key block, a mixed string of high entropy.
PREFIXED = re.compile(r"(?:gh[pousr]_|xox[abpr]-|sk-|glpat-|AIza)[A-Za-z0-9_-]{16,}")
SIGNED_PART = re.compile(r"[A-Za-z0-9_-]+")
SIGNED_LEAST = 8
BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
MIXED = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
MIXED_BITS = 4.0
MORE = ("prefixed", "signed", "block", "mixed")
KINDS = (*BASE, *MORE)
ORDER = {k: i for i, k in enumerate(KINDS)}

#: Above this many distinct owners a value is a copied example.
COPIED_OWNERS = 2

Span = tuple[int, int, str, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind, value) of the base matches."""
    out: list[Span] = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def signed(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the signed tokens: three parts joined by dots, from the first ``eyJ`` of the first one; in one pass."""
    parts: list[tuple[int, int]] = []
    for m in SIGNED_PART.finditer(text):
        if parts and not (m.start() == parts[-1][1] + 1 and text[m.start() - 1] == "."):
            parts.clear()
        parts.append(m.span())
        if len(parts) == 3:
            at = text.find("eyJ", *parts[0])
            if at >= 0 and parts[0][1] - at >= 3 + SIGNED_LEAST and all(b - a >= SIGNED_LEAST for a, b in parts[1:]):
                yield at, parts[2][1]
                parts.clear()
            else:
                parts.pop(0)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans that do not touch each other and cover the same places."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def more_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates of the further patterns that touch no base span and no earlier candidate, one kind after the other."""
    kinds: list[list[Span]] = [[(m.start(), m.end(), "prefixed", m[0]) for m in PREFIXED.finditer(text)]]
    kinds.append([(a, b, "signed", text[a:b]) for a, b in signed(text)] if "eyJ" in text else [])
    kinds.append([(m.start(), m.end(), "block", m[0]) for m in BLOCK.finditer(text)] if "-----BEGIN" in text else [])
    mixed = []
    for m in MIXED.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v) and entropy(v) >= MIXED_BITS:
            mixed.append((m.start(), m.end(), "mixed", v))
    kinds.append(mixed)
    taken, out = union([(s[0], s[1]) for s in base]), []
    for found in kinds:  # of one kind, in order and apart
        free, i = [], 0
        for s in found:
            while i < len(taken) and taken[i][1] <= s[0]:
                i += 1
            if i == len(taken) or taken[i][0] >= s[1]:
                free.append(s)
        taken = union(taken + [(s[0], s[1]) for s in free]) if free else taken
        out += free
    return out


def written(spans: Iterable) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, *_ in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """One row per document: the base counts and digest, and every candidate with its value's hash."""
    candidate = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.binary())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, counts, found = [], {k: [] for k in BASE}, []
            for x in batch["text"]:
                t = x.as_py() or ""
                base = base_spans(t)
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                of = Counter(s[2] for s in base)
                for k in BASE:
                    counts[k].append(of[k])
                found.append([{"start": s[0], "end": s[1], "kind": s[2], "value": hashlib.blake2b(s[3].encode(), digest_size=16).digest()} for s in (*base, *more_spans(t, base))])
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("doc_id", "owner", "seal")} | {f"n_{k}": pa.array(counts[k], pa.int64()) for k in BASE} | {"base_sha256": pa.array(digests, pa.string()), "found": pa.array(found, pa.list_(candidate))})

    picked = docs.select(column(docs, key, "long").alias("doc_id"), column(docs, owner, "string").alias("owner"), column(docs, text, "string").alias("text")).withColumn("seal", F.xxhash64("text"))
    return picked.mapInArrow(work, "doc_id long, owner string, seal long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:long,end:long,kind:string,value:binary>>")


def ownership(candidates: DataFrame) -> DataFrame:
    """For each value: its distinct owners and repositories over the corpus, and whether it looks live.

    Both counts are combined before each shuffle, so a value in a third of all rows sends one row per task.
    """
    value, owner, doc = F.col("value"), F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    pairs = candidates.select(value, F.explode(F.array(F.struct(F.lit(0).alias("what"), owner.alias("name")), F.struct(F.lit(1).alias("what"), doc.alias("name")))).alias("x"))
    counts = pairs.select("value", "x.*").distinct().groupBy("value").agg(F.count_if(F.col("what") == 0).alias("n_owners"), F.count_if(F.col("what") == 1).alias("n_repositories"))
    return counts.withColumn("live", F.col("n_owners") <= COPIED_OWNERS)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, live_spans, most_repositories).

    ``most_repositories`` is in how many documents the most repeated of a document's values is.
    """
    # the ids are fixed by the written checkpoint, so both uses below see the same ones
    scanned = cut(scan(docs, key, text, owner).withColumn("row", F.monotonically_increasing_id()))
    each = scanned.where(F.size("found") > 0).select("row", "owner", "doc_id", F.explode("found").alias("c")).select("row", "owner", "doc_id", "c.*")
    judged = each.select("row", "start", "end", "kind", "value").join(ownership(each).select("value", "live", "n_repositories"), "value")
    order = F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])[F.col("kind")]
    base = F.col("kind").isin(*BASE)
    span = F.struct("start", order.alias("at"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("said"))
    by_row = (
        judged.groupBy("row")  # a document's own spans
        .agg(
            F.collect_list(F.when(base | F.col("live"), span)).alias("all"), F.collect_list(F.when(F.col("live"), span)).alias("alive"),
            F.count_if(base & F.col("live")).alias("n_live"), F.count_if(base & ~F.col("live")).alias("n_copied"), F.max("n_repositories").alias("most_repositories"),
        )
        .select("row", "n_live", "n_copied", "most_repositories", *[F.concat_ws(",", F.transform(F.array_sort(c), lambda s: s["said"])).alias(n) for c, n in (("all", "spans"), ("alive", "live_spans"))])
    )
    rest = scanned.drop("found", "owner")
    zero = F.lit(0).cast("long")
    return rest.join(by_row, "row", "left").select(
        "doc_id", "seal", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"), F.coalesce("live_spans", F.lit("")).alias("live_spans"),
        F.coalesce("most_repositories", zero).alias("most_repositories"),
    )


def mask_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """``docs`` with each live-looking secret replaced by ``[kind]``; widely copied examples stay.

    Rows of one id and text are masked alike, a null text stays null, and any other columns pass through.
    """
    id_, seal, spans = (fresh(docs, n) for n in ("live_id", "live_seal", "live_spans"))
    live = scan_secrets(docs, key, text, owner).where("live_spans <> ''").select(F.col("doc_id").alias(id_), F.col("seal").alias(seal), F.col("live_spans").alias(spans)).distinct()
    joined = docs.join(live, docs[key].cast("long").eqNullSafe(live[id_]) & (F.xxhash64(docs[text]) == live[seal]), "left")
    # spans are kind:start:end in code points, from 0; the text is put together from what lies between them
    cuts = F.transform(F.split(spans, ","), lambda s: F.struct(F.split(s, ":")[0].alias("kind"), F.split(s, ":")[1].cast("int").alias("a"), F.split(s, ":")[2].cast("int").alias("b")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, c: F.struct(
        F.when(c["b"] <= acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.greatest(c["a"] - acc["at"], F.lit(0))), F.lit("["), c["kind"], F.lit("]"))).alias("out"),
        F.greatest(acc["at"], c["b"]).alias("at"),
    )
    masked = F.aggregate(cuts, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return joined.withColumn(text, F.when(F.col(spans).isNotNull(), masked).otherwise(F.col(text))).select(*docs.columns)


def op6_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents")).drop("seal")
