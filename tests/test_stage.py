"""Stage tables of queries that run beside each other in one session."""

import threading

from tessella.sources import tables


def test_a_run_deletes_only_its_own_tables(spark):
    """One thread drops what it staged while another still reads what it staged meanwhile."""
    ready, dropped, seen = threading.Event(), threading.Event(), {}

    def other():
        df = tables.stage(spark.range(7), "other")
        ready.set()
        dropped.wait(60)
        seen["rows"], seen["staged"] = df.count(), len(tables.STAGED)

    mark = len(tables.STAGED)
    first = tables.stage(spark.range(5), "own")
    thread = threading.Thread(target=other)
    thread.start()
    assert ready.wait(60)
    kept = tables.stage(first.where("id > 1"), "kept")
    tables.release_since(mark, kept)
    dropped.set()
    thread.join(60)
    assert seen == {"rows": 7, "staged": 1} and kept.count() == 3
    assert len(tables.STAGED) == mark + 1
    folder = first.inputFiles()[0].rpartition("/")[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
