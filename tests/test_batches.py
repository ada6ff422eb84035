"""A Python worker's memory follows neither the size of its batches nor the number of pages."""

import pyarrow as pa

from pagesift.functions import udfs as U
from pagesift.session import BATCH_BYTES, BATCH_ROWS, bounded_batches

KEYS = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]


def test_batches_of_pages_are_bounded_in_rows_and_bytes(spark):
    before = [spark.conf.get(k) for k in KEYS]
    try:
        for k in KEYS:
            spark.conf.unset(k)
        for k, v in zip(KEYS, ("10000", "67108864b")):  # Spark's defaults, as a plain session has them
            spark.conf.set(k, v)
        bounded_batches(spark)
        assert [spark.conf.get(k) for k in KEYS] == [str(BATCH_ROWS), str(BATCH_BYTES)]
        spark.conf.set(KEYS[0], "77")
        bounded_batches(spark)
        assert spark.conf.get(KEYS[0]) == "77"
    finally:
        for k, v in zip(KEYS, before):
            spark.conf.set(k, v)


def test_few_rows_are_python_objects_at_once():
    seen = []

    def twice(rows):
        seen.append(len(rows))
        return [None if r is None else r * 2 for r in rows]
    out = U.by_slices(twice, pa.string(), pa.array([None, *"abc" * 30]))
    assert out.to_pylist() == [None, *("aa", "bb", "cc") * 30] and max(seen) == U.SLICE and sum(seen) == 91
    assert U.by_slices(twice, pa.string(), pa.array([], pa.string())).to_pylist() == []


def test_fold_gives_the_same_events_in_any_batch():
    pages = [["<html>", "<p>", f"text {i} &amp; more", "</p>", "</html>"] if i % 7 else None for i in range(50)]
    whole = U._folder(15)(pa.array(pages, pa.list_(pa.string()))).to_pylist()
    single = [U._folder(15)(pa.array([p], pa.list_(pa.string()))).to_pylist()[0] for p in pages]
    assert whole == single and whole[1]["run"][1] == "text 1 & more" and whole[0]["kind"] == []
