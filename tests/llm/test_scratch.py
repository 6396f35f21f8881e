"""Intermediate tables of one thread aren't deleted by another's."""

import threading

from keidai.llm.common import scratch, written


def test_scratch_is_per_thread(spark):
    ready, over, seen = threading.Event(), threading.Event(), {}

    def other():
        with scratch(spark):
            seen["table"] = written(spark.range(3).toDF("n"), "other")
            ready.set()
            over.wait(60)
            seen["rows"] = seen["table"].count()  # still there after the first thread's scratch has ended

    t = threading.Thread(target=other)
    with scratch(spark):
        mine = written(spark.range(2).toDF("n"), "mine")
        t.start()
        ready.wait(60)
        assert mine.count() == 2
    over.set()
    t.join()
    assert seen["rows"] == 3
