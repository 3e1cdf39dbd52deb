"""Written tables leave no shuffle files behind."""

import time

from reportloom.llm.common import written


def test_shuffle_files_go_with_their_job(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: manager.getAllFiles().mkString(" ").count("shuffle_")
    before = held()
    rows = written(spark.range(100_000).repartition(4, "id"), "rows")
    for _ in range(50):  # they go in the background
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and rows.count() == 100_000
