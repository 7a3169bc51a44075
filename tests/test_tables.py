import time

from helixmill.plans import tables


def test_shuffle_files_go_when_a_table_is_stored(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x.rpartition("/")[2] for x in files.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = shuffled()
    table = tables.stored(spark.range(1000).repartition(7, "id"), "dealt")
    for _ in range(100):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and table.count() == 1000
    assert spark.conf.get(tables.CLEANUP, "false") == "false"
