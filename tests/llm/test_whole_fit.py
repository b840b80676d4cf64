"""The classifier's fit reads every labelled row."""

from pyspark.sql import functions as F

from songfield.llm import toxicity


def test_a_word_of_the_last_rows_is_learned(spark):
    """A fit on 6,000 rows in the order of a hash never saw the second word."""
    last = [r["id"] for r in spark.range(7000).orderBy(F.xxhash64(F.lit(0), "id"), "id").collect()][6000:]
    late, early = set(last[::5]), {i for i in range(0, 7000, 20) if i not in set(last)}
    word = lambda i: "vileness" if i in late else "scumbag" if i in early else "garden"
    docs = spark.createDataFrame([(i, f"a {word(i)} {'little green old'.split()[i % 3]} house", "x") for i in range(7000)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i in late or i in early)) for i in range(7000)], "doc_id bigint, toxic int")
    model, bars = toxicity.train(docs, labels, share=2500)  # three tasks at most
    odd = spark.createDataFrame([(1, "a vileness green house", "x"), (2, "a scumbag green house", "x"), (3, "a garden green house", "x")], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model, bars).collect()}
    assert got[1] >= 0.3 and got[2] >= 0.3 and got[3] < 0.3


def test_texts_without_a_label_are_not_shuffled(spark):
    """The fit's join dealt out every text, with a label or not."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(str(i))), 256) for i in range(20)])).alias("text"), F.lit("x").alias("lang"))
    labels = spark.range(0, 4000, 100).select(F.col("id").cast("int").alias("doc_id"), (F.col("id") % 200 == 0).cast("int").alias("toxic"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    shuffled = lambda: sum(x.totalShuffleWrite() for x in [spark.sparkContext._jsc.sc().statusStore().executorSummary("driver")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = toxicity.marked(docs, labels.select(F.col("doc_id").cast("bigint").alias("doc_id")))
        assert kept.count() < 100 and kept.filter("doc_id % 100 = 0").count() == 40
        before = shuffled()
        toxicity.train(docs, labels)
        assert shuffled() - before < 4_000_000 / 2  # all texts: 4,000 of 1,300 characters, which hardly compress
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
