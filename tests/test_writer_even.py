"""Slow compression is spread over the cores, however few row groups the rows are read from."""

import pyarrow as pa
import pyarrow.parquet as pq

from colscan import catalogue
from colscan.sources.writer import LEAST_BYTES, TASK_BYTES, evenly


def test_one_row_group_is_compressed_in_many_tasks(spark, tmp_path):
    texts = [None if i % 50 == 0 else " ".join(f"{(i + j) * 7919 % 1000003:x}" for j in range(500)) for i in range(2000)]
    pq.write_table(pa.table({"doc_id": pa.array(range(2000), pa.int64()), "text": texts}), f"{tmp_path}/documents.parquet")
    df = catalogue.queries()["writer_zstd_level"](spark, str(tmp_path))
    rows = df.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == list(enumerate(texts)) and all(r.smaller for r in rows)
    files = [pq.read_metadata(f.removeprefix("file://")) for f in df.inputFiles()]
    assert len(files) >= spark.sparkContext.defaultParallelism
    assert max(m.num_rows for m in files) < 2 * min(m.num_rows for m in files)


def test_tasks_grow_with_the_bytes(spark):
    cores, tasks = spark.sparkContext.defaultParallelism, lambda n: evenly(spark.range(10), n).rdd.getNumPartitions()
    assert [tasks(n) for n in (0, 5, 2 * LEAST_BYTES, 100 * LEAST_BYTES)] == [1, 1, 2, 3 * cores]
    assert tasks(1000 * TASK_BYTES + 1) == 1001


def test_no_documents(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), f"{tmp_path}/documents.parquet")
    assert catalogue.queries()["writer_zstd_level"](spark, str(tmp_path)).collect() == []
