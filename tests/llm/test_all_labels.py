"""The quality rules are measured on every good row that isn't held out, however many there are."""

from pyspark.sql import functions as F

from larkspur.llm import quality_rules


def test_rules_come_from_all_good_rows(spark):
    words = "array_join(transform(sequence(1, 60), i -> if(i % 5 = 0, 'the', concat('w', (id * 31 + i * i * i) % 4999))), ' ')"
    ids = spark.range(28_000).selectExpr("id AS doc_id", f"{words} AS text")
    learned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    assert ids.where(learned).count() > 20_500
    last = ids.where(learned).orderBy(F.desc(F.xxhash64("doc_id"))).first().doc_id
    docs = ids.withColumn("lang", F.when(F.col("doc_id") == last, "xx").otherwise("en"))
    got = quality_rules.labelled_rules(docs, ids.selectExpr("doc_id", "1 AS quality"))
    whole = quality_rules.measured(docs.where(learned), share=1.0, slack=0.5)
    assert set(got.references) == {"en", "xx"} and got.references["en"].words["the"] == 0.2
    assert got == whole


def test_held_out_and_bad_rows_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = docs.join(labels.where((F.col("quality") == 1) & ~held), "doc_id", "left_anti").select("doc_id")
    assert other.count() > 0
    changed = docs.join(other.withColumn("odd", F.lit("zz ZZ 99 ##")), "doc_id", "left").withColumn("text", F.coalesce("odd", "text"))
    assert quality_rules.labelled_rules(changed, labels) == quality_rules.labelled_rules(docs, labels)
