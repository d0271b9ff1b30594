import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewheel.llm import decontaminate, language, mixing, near_dedup, token_output

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = (before, docs)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = lambda frame: sorted(r["doc_id"] for r in frame.select("doc_id").collect())
    before, after = seen["language_id"]
    assert ids(after) == ids(language.identify(before).where("not rejected"))
    before, after = seen["near_dedup"]
    assert ids(after) == ids(near_dedup.near_duplicates(before).where("kept"))
    before, after = seen["decontamination"]
    assert ids(after) == ids(decontaminate.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("kept"))
    before, after = seen["mixing"]
    taken = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixing.mix(before).where("taken > 0").collect()}
    assert ids(after) == sorted(i for i, n in taken.items() for _ in range(n))
    before, after = seen["token_output"]
    assert ids(after) == ids(before) and len({r["start"] for r in after.collect()}) == before.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


@pytest.mark.parametrize("name", ["pipeline", "op1_minhash_near_dedup", "op9_lm_scoring"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()


HIDDEN = ["kept_id", "kept_rows", "bad_key", "mix_key", "mix_at", "mix_source", "mix_size", "mix_taken", "mix_have", "mix_want", "mix_words", "_mix_key", "id", "key", "__id", "__rows", "__words"]


def test_columns_of_any_name(spark, clashing):
    """What the operators call their own columns, as columns of the table."""
    docs = clashing
    for name in HIDDEN:
        docs = docs.withColumn(name, F.lit(name)) if name not in ("id", "key") else docs
    items = spark.createDataFrame([(1, docs.first()["text"])], "item_id long, text string")
    for out in (near_dedup.drop_near_duplicates(docs), mixing.mixed(docs), decontaminate.drop_contaminated(docs, items), decontaminate.drop_contaminated(docs, items, broadcast_bytes=0), language.keep_identified(docs)):
        rows = out.collect()
        assert out.columns == docs.columns and rows and all(r[x] == x for r in rows for x in HIDDEN if x not in ("id", "key"))


def test_stages_of_an_empty_table(spark, empty, tmp_path):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for out in (near_dedup.drop_near_duplicates(empty), mixing.mixed(empty), decontaminate.drop_contaminated(empty, items), decontaminate.drop_contaminated(empty, items, broadcast_bytes=0), language.keep_identified(empty)):
        assert out.count() == 0 and out.columns == empty.columns
    assert token_output.token_files(empty, str(tmp_path / "none")).count() == 0


def test_very_long_texts(spark):
    """Texts of megabytes, one of them a single word, through each operator."""
    long = " ".join(f"word{i}" for i in range(200_000))
    rows = [(1, long, "en", "a", len(long)), (2, long + " tail", "en", "a", len(long) + 5), (3, "x" * 3_000_000, "en", "b", 3_000_000), (4, "a few plain words here", "en", "b", 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    items = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(500, 560)))], "item_id long, text string")
    for limit in (0, 1 << 20):
        assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, items, broadcast_bytes=limit).select("doc_id").collect()) == [3, 4]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    assert sum(taken.values()) > 0 and mixing.mixed(docs).count() >= 2
