"""Line dedup gives its shuffle files back step by step."""

from finlake.llm import linededup

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_") and f.endswith(".data")}


def test_no_shuffle_files_stay_behind(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, "\n".join(" ".join(words[(i * j) % 7 : 20 + j]) for j in range(12))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before, had = spark.conf.get(KEY, None), shuffle_files(spark)
    found = linededup._matches(docs, False, 0.8, 1, 64)
    assert not shuffle_files(spark) - had
    assert found.count() and spark.conf.get(KEY, None) == before
