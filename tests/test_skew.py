"""One key with a third or more of all rows: results stay whole and plans stay split."""

from pyspark.sql import functions as F

from qamill.operators import bias as bi
from qamill.operators import corpus as co
from qamill.operators import gold as go
from qamill.operators import questions as qu
from qamill.operators import summary as su
from qamill.plans.fixtures import table


def plan(df):
    return df._jdf.queryExecution().toString()


def test_hot_stratum_split_is_exact(spark):
    df = spark.range(60000).select(F.col("id").cast("string").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("lang"))
    sizes = {(r["lang"], r["split"]): r["n"] for r in co.split_sizes(co.assign_splits(df, stratum="lang"), "lang").collect()}
    assert sizes[("hot", "train")] == 28000 and sizes[("hot", "val")] == 6000 and sizes[("hot", "test")] == 6000
    # rows are ranked per hash bucket, never per stratum alone
    text = plan(co.assign_splits(df, stratum="lang"))
    assert "hashpartitioning(_stratum" in text and "_bucket" in text


def test_hot_system_keeps_rank_limits_in_the_tasks(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("system"),
                                   F.lit(True).alias("success"), (F.col("id") % 97 / 97).alias("score"), F.col("id").alias("question_ix"))
    best = su.best_and_worst(df, ["system"])
    assert "WindowGroupLimit" in plan(best)
    assert [r["question_ix"] for r in best.where("system = 'hot' AND kind = 'best'").orderBy("rank").collect()] == [
        i for i in range(20000) if i % 97 == 96 and i % 10][:5]


def test_hot_question_text_is_reduced_before_the_shuffle(spark):
    df = spark.range(30000).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("paper_id"), F.lit("open_ended").alias("query_type"),
        F.when(F.col("id") % 3 > 0, "What are the main contributions?").otherwise(F.concat(F.lit("What of "), F.col("id").cast("string"), F.lit("?"))).alias("question"),
        F.xxhash64("id").alias("pick"))
    got = qu.distinct_questions(df)
    assert got.count() == 10001 and "partial_min_by" in plan(got)


def test_hot_paper_joins_once(spark):
    questions = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("paper_id"),
        F.col("id"), F.lit("nets").alias("term"))
    papers = spark.createDataFrame(
        [("hot", [("Intro", "We like nets. They work.")], [])],
        "paper_id string, sections array<struct<heading:string,content:string>>, concepts array<struct<text:string,type:string,count:bigint,examples:array<struct<section:string,context:string>>>>")
    got = go.passages(questions, papers)
    assert got.count() == 2000 and got.where(F.size("passages") == 1).count() == 2000


def test_group_statistics_never_gather_rows(spark):
    df = spark.range(1000).select(F.lit("s").alias("system"), F.lit(True).alias("success"), F.rand(1).alias("score"), F.lit("x").alias("f"))
    text = plan(bi.scores_by_field(df, ["f"]))
    assert "collect_list" not in text and "CartesianProduct" not in text


def test_no_operator_uses_local_checkpoints_or_rdds():
    import pathlib

    root = pathlib.Path(bi.__file__).parent.parent
    for path in root.rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and ".collect()" not in text, path


def test_hot_paper_question_selection_is_limited_in_the_tasks(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 50).cast("string"))).alias("paper_id"),
        F.element_at(F.array(*[F.lit(t) for t in ("factoid", "causal", "open_ended")]), (F.col("id") % 3 + 1).cast("int")).alias("query_type"),
        F.concat(F.lit("What of "), F.col("id").cast("string"), F.lit("?")).alias("question"), F.xxhash64("id").alias("pick"))
    got = qu.select_questions(df, 20)
    assert plan(got).count("WindowGroupLimit") >= 3
    counts = {r["paper_id"]: r["count"] for r in got.groupBy("paper_id").count().collect()}
    assert set(counts.values()) == {20}


def test_one_row_group_over_many_splits_reaches_all_cores(spark, tmp_path):
    """A file of one row group is one task, however many splits it has."""
    path = str(tmp_path / "documents.parquet")
    spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("text")).coalesce(
        1).write.parquet(path)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        cores = spark.sparkContext.defaultParallelism
        assert spark.read.parquet(path).rdd.getNumPartitions() >= cores
        rows = table(spark, str(tmp_path), "documents")
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and len(sizes) >= cores and max(sizes) <= 2 * 4000 / cores
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
