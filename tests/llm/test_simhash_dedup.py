import random
import re

import xxhash

from weftgraph.llm import simhash_dedup as S


def print_by_hand(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(items, distance):
    root = [*range(len(items))]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if distance(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(), key=lambda d: d["doc_id"])
    prints = [print_by_hand(d["text"]) for d in docs]
    roots = components_by_hand(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    want = sorted((d["doc_id"], f"{p:016x}", docs[r]["doc_id"]) for d, p, r in zip(docs, prints, roots, strict=True))
    assert sorted(map(tuple, S.op4_simhash_dedup(spark, folder).collect())) == want


def test_awkward_rows(spark, awkward, nothing, folder):
    rows = S.op4_simhash_dedup(spark, folder(documents=awkward)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 13
    assert by[2]["fingerprint"] == "0" * 16 and {by[i]["component_id"] for i in (2, 3, 4)} == {2}
    assert by[7]["component_id"] == 6 and by[8]["component_id"] == 1
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    assert all(r["fingerprint"] == f"{print_by_hand(texts[r['doc_id']]):016x}" for r in rows)
    assert S.op4_simhash_dedup(spark, folder(documents=nothing)).collect() == []


def test_links_connect_as_all_pairs_do(spark):
    rng = random.Random(4)
    prints = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
            x ^= rng.choice([0, 1 << rng.randrange(64)])
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = components_by_hand(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    found = S.components(S.links(spark.createDataFrame([(s,) for s in signed], "print long"))).collect()
    of = {r["node"]: r["root"] for r in found}
    groups, want = {}, {}
    for s, r in zip(signed, roots, strict=True):
        groups.setdefault(of.get(s, s), set()).add(s)
        want.setdefault(r, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)]
    of = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(of.get(i, 0) == 0 for i in range(201)) and all(of[1000 + i] == 1000 for i in range(1, 50))


def test_one_of_each(spark, awkward):
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in S.one_of_each(awkward).collect())
    assert ids == [(False, i) for i in (1, 2, 5, 6, 9, 10, 11)] + [(True, 0)]


def shingles_by_hand(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_hand(texts):
    """The first of each group over all pairs, by fingerprints or 5-word shingles at 0.8."""
    seen = [(print_by_hand(t), shingles_by_hand(t)) for t in texts]
    roots = components_by_hand(seen, lambda x, y: (x[0] ^ y[0]).bit_count() <= 2 or 5 * len(x[1] & y[1]) >= 4 * len(x[1] | y[1]))
    return sorted({*roots})


def test_block_insertions_against_all_pairs(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts = []
    for i in range(60):
        words = [word() for _ in range(rng.choice([60, 200, 700]))]
        new = int(len(words) * (0.05 + 0.25 * i / 60))
        at = rng.choice([0, len(words) // 2, len(words)])
        texts += [" ".join(words), " ".join(words[:at] + [word() for _ in range(new)] + words[at:])]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert 60 < len(kept_by_hand(texts)) < 90
    assert sorted(r["doc_id"] for r in S.one_of_each(docs).collect()) == kept_by_hand(texts)


def test_shingles_at_the_threshold_are_counted_whole(spark):
    texts = []
    for i in range(40):
        words = [f"w{i}x{j}" for j in range(804)]  # 800 shingles; k more behind them give 800 / (800 + k)
        texts += [" ".join(words), " ".join(words + [f"v{i}x{j}" for j in range(200 + i % 2)])]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in S.one_of_each(docs).collect()) == [j for i in range(40) for j in ([2 * i, 2 * i + 1] if i % 2 else [2 * i])]


def test_same_words_in_other_orders(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(30):
        rng.shuffle(words)
        texts += [" ".join(words), " ".join(words[:-1]), " ".join([*words[50:], *words[:50]])]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in S.one_of_each(docs).collect()) == kept_by_hand(texts)


def test_different_texts_with_null_or_equal_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (None, texts[4]), ((1 << 63) - 1, texts[5]), (None, texts[0])]
    kept = S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, kept)) == sorted(map(str, spark.createDataFrame(rows[:5] + rows[6:7], "doc_id long, text string").collect()))


def test_clusters_against_all_pairs(spark):
    """Near copies with few and many edits, versions that drift, shortened ones, and texts that share a form."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts = []
    for size in (60, 150):
        base = [word() for _ in range(size)]
        pool = [word() for _ in range(6)]
        for _ in range(45):  # edits of one text, of new words and of words that several take
            words = list(base)
            for at in rng.sample(range(size), rng.randint(1, size // 18)):
                words[at] = rng.choice(pool) if rng.random() < 0.4 else word()
            texts.append(" ".join(words))
        words = list(base)
        for _ in range(25):  # each version differs little from the one before
            words[rng.randrange(size)] = word()
            texts.append(" ".join(words))
        for _ in range(15):
            low = rng.randint(0, size // 4)
            texts.append(" ".join(base[low : low + size - size // 4]))
        for _ in range(15):
            texts.append(" ".join(base[: size * 3 // 4] + [word() for _ in range(size // 4)]))
    rng.shuffle(texts)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in S.one_of_each(docs).collect()) == kept_by_hand(texts)


def test_pairs_by_rest_are_complete_and_meet_in_few_shingles(spark):
    """Texts tried with one text: those that share blocks beyond it meet in few shingles, and none that shares enough is left out."""
    rng = random.Random(8)
    blocks = [[rng.getrandbits(60) for _ in range(400)] for _ in range(6)]
    own = lambda k: [rng.getrandbits(60) for _ in range(k)]
    rests = [{*rng.sample(block, rng.randint(300, 400)), *own(rng.randint(0, 80))} for block in blocks for _ in range(8)]
    both = [rng.randint(150, 400) for _ in rests]
    sizes = [len(r) + k for r, k in zip(rests, both, strict=True)]
    rest = spark.createDataFrame([(s, 1000, i, sizes[i]) for i, r in enumerate(rests) for s in sorted(r)], "shingle long, of long, node long, n int")
    placed = spark.createDataFrame([(i, i, 1000, k) for i, k in enumerate(both)], "node long, root long, of long, both int")
    pairs = [(i, j) for j in range(len(rests)) for i in range(j) if 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j])]
    want = {(i, j) for i, j in pairs if 9 * (len(rests[i] & rests[j]) + min(both[i], both[j])) >= 4 * (sizes[i] + sizes[j])}
    found = {(r["a"], r["b"]) for r in S.pairs_by_rest(rest, placed).collect()}
    assert want <= found and len(want) > 10
    held = [{r["shingle"] for r in S.rest_prefixes(rest, placed).where(f"node = {i}").select("shingle").collect()} for i in range(8)]
    whole = sum(len(rests[i] & rests[j]) for j in range(8) for i in range(j))
    assert 0 < 2 * sum(len(held[i] & held[j]) for j in range(8) for i in range(j)) < whole


def most_joined(spark, work):
    """The result of ``work`` and the most rows that one join made meanwhile."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    listed = lambda: [(x := store.executionsList()) and x.apply(i).executionId() for i in range(store.executionsList().size())]
    bus.waitUntilEmpty(30_000)
    before, result, most = {*listed()}, work(), 0
    bus.waitUntilEmpty(30_000)
    for e in {*listed()} - before:
        nodes, values = store.planGraph(e).allNodes(), store.executionMetrics(e)
        for node in map(nodes.apply, range(nodes.size())):
            for metric in map(node.metrics().apply, range(node.metrics().size() if "Join" in node.name() else 0)):
                if metric.name() == "number of output rows" and values.get(metric.accumulatorId()).isDefined():
                    most = max(most, int(values.get(metric.accumulatorId()).get().replace(",", "")))
    return result, most


def test_pairs_left_are_complete_and_joins_make_no_more_rows_than_they_read(spark):
    """Texts that share lines with very many others, but too little with any one, don't meet in those lines."""
    rng = random.Random(13)
    count = 480
    nodes = range(count)
    held = [{10_000 + 10 * (i // 120) + j for j in range(6)} for i in nodes]  # lines of 120 texts
    for i in nodes:  # and a little that two or three hold
        for j in range(5):
            shingle = 100_000 + 10 * (i // 2) + j
            held[i].add(shingle)
            held[(i + 7) % count].update([shingle] if j == 0 else [])
    for i in range(0, count, 12):  # and what many links share
        shingles = [1_000_000 + 100 * i + j for j in range(40)]
        for j in rng.sample(range(12), 4):
            held[i + j].update(rng.sample(shingles, 36))
    n = [rng.randint(180, 220) for _ in nodes]
    of = [i // 4 * 4 if i % 24 < 12 else i for i in nodes]  # some were tried with the same text
    both = [n[i] if of[i] == i else min(n[i], rng.randint(150, 220)) for i in nodes]
    root = [i // 2 * 2 if rng.random() < 0.2 else i for i in nodes]
    needed = lambda i, j: -(-4 * (n[i] + n[j]) // 9)
    behind = lambda i: -(-4 * n[i] // 5) - 1 - n[i] // 20
    sized = [(i, j) for j in nodes for i in range(j) if root[i] != root[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j])]
    want = {(i, j) for i, j in sized if len(held[i] & held[j]) >= needed(i, j) - max(behind(i), behind(j)) and (of[i] != of[j] or needed(i, j) <= min(both[i], both[j]))}
    assert {of[i] == of[j] for i, j in want} == {True, False} and len(want) > 100
    shared = spark.createDataFrame([(s, i, n[i], (1, i)) for i in nodes for s in sorted(held[i])], "shingle long, node long, n int, top struct<weight:int,node:long>")
    placed = spark.createDataFrame([*zip(nodes, root, of, both, strict=True)], "node long, root long, of long, both int")
    found, most = most_joined(spark, lambda: {(r["a"], r["b"]) for r in S.pairs_left(shared, placed).collect()})
    assert want <= found and len(found) < 2 * len(want)
    assert most <= sum(map(len, held))


def test_arrow_batches_are_small_meanwhile_and_as_before_after(spark, awkward, monkeypatch):
    seen, grouped = [], S.grouped
    monkeypatch.setattr(S, "grouped", lambda docs, *a: seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or grouped(docs, *a))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    S.one_of_each(awkward)
    assert seen == [str(S.TEXTS)] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
