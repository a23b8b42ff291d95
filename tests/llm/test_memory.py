import numpy as np
import pyarrow as pa

from quillspan.llm import memory, substring


def test_batches_leave_in_pieces():
    lists = [list(range(k, k + n)) for k, n in enumerate([10, 300_000, 0, 5, 200_000, 7, 100_000, 100_000])]
    whole = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.int64()))], ["k", "v"])
    got = list(memory.releasing(lambda batches: batches)(iter([whole, whole.slice(0, 0)])))
    assert pa.Table.from_batches(got).to_pylist() == whole.to_pylist()
    assert len(got) > 3 and all(x.nbytes <= memory.BATCH_BYTES or x.num_rows == 1 for x in got)


def test_windows_are_batched_by_bytes():
    schema = pa.schema([("key", pa.int64()), ("one", pa.list_(pa.int64()))])
    rows = [(k, np.full(20_000, k)) for k in range(100)]  # 16 MB, fewer than 400 rows
    got = list(substring._batched(iter(rows), schema))
    assert [k for b in got for k in b.column("key").to_pylist()] == list(range(100))
    assert max(b.nbytes for b in got) < 1.5 * memory.BATCH_BYTES
