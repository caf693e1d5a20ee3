"""State and windows against recomputation."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.streaming import median, windows
from millrace.streaming.runs import drained


def test_incremental_median_equals_recomputation(spark, tmp_path):
    draw = random.Random(5)
    here: dict[tuple, dict[int, str]] = {}
    feed = []
    for batch in range(4):
        rows = []
        for _ in range(30):
            key = (draw.randrange(2), 1, draw.choice("ab"))
            group = here.setdefault(key, {})
            if group and draw.random() < 0.4:
                gone = draw.choice(sorted(group))
                if ("insert", key, gone) not in {(r[0], r[1:4], r[5]) for r in rows}:
                    rows.append(("delete", *key, None, gone))
                    del group[gone]
            else:
                new = draw.randrange(1000)
                if ("delete", key, new) not in {(r[0], r[1:4], r[5]) for r in rows}:
                    group[new] = str(draw.randrange(50))
                    rows.append(("insert", *key, group[new], new))
        feed.append(rows)
        spark.createDataFrame(rows, median.FEED).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(median.FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    got = {tuple(r[:3]): tuple(r[3:]) for r in median.latest(drained(median.incremental_median(stream), "update")).collect()}
    want = {}
    for key, group in here.items():
        order = sorted((first, i) for i, first in group.items())
        if order:
            want[key] = order[len(order) // 2]
    assert got == want


def test_arrival_window_with_a_slide_larger_than_the_window(spark):
    start = datetime(2024, 1, 1)
    items = [(start + timedelta(seconds=s), v) for s, v in ((0.6, 1), (1.0, 2), (1.4, 3), (2.5, 4), (2.4, 5))]
    df = spark.createDataFrame(items, "ts timestamp_ntz, v int")
    got = windows.arrival_window(df, "ts", "v", timedelta(seconds=1), timedelta(milliseconds=500))
    want = {(start + timedelta(seconds=1), 2, 3.0), (start + timedelta(seconds=3), 1, 4.0)}  # an age of exactly the size is in
    assert set(map(tuple, got.collect())) == want
    both = windows.concurrent_windows(df, "ts", "v", {"a": (timedelta(seconds=1), timedelta(milliseconds=500)), "b": (timedelta(seconds=1), timedelta(seconds=2))})
    assert {tuple(r[1:]) for r in both.where(F.col("name") == "a").collect()} == want
