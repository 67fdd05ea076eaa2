import corpus_pipeline as C
from weftgraph.llm.language_id import UNKNOWN


def stage(spark, name, docs):
    return dict(C.STAGES)[name](spark, docs, "/root/testdata/sf0.001")


def test_run_and_stages_of_the_smallest_tables(spark):
    rows = C.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and set(rows[0].asDict()) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and all(r["lossless"] for r in rows)
    ids = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} <= ids


def test_language_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = stage(spark, "language", docs)
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.collect())
    junk = docs.limit(1).selectExpr("-1L AS doc_id", "'123 456 !!!' AS text", "'en' AS lang", "source", "n_chars")
    assert stage(spark, "language", docs.union(junk)).where("doc_id = -1").count() == 0
    assert UNKNOWN == "und"


def test_one_document_of_each_group_stays(spark):
    words = [f"word{i}" for i in range(400)]
    near = [*words[:200], "other", *words[201:]]
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(words)), (7, " ".join(words[::-1])), (8, "short one"), (9, "short two")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in stage(spark, "near_duplicates", docs).collect()) == [1, 7, 8, 9]


def test_stages_with_awkward_documents(spark, awkward, nothing):
    columns = C.COLUMNS
    for docs in (awkward.select(*columns), nothing.select(*columns)):
        for name, _ in C.STAGES:
            out = stage(spark, name, docs)
            assert name == "encoding" or out.columns == columns
            out.collect()
