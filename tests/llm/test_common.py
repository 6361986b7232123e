import pyarrow as pa

from strataflow.llm.common import batched

SCHEMA = pa.schema([("k", pa.int64()), ("s", pa.string()), ("b", pa.binary())])


def test_batches_end_by_rows_or_by_length_of_texts():
    rows = [(k, "x" * (k % 5), None) for k in range(100)] + [(k, None, b"y" * 1000) for k in range(100, 110)]
    got = list(batched(iter(rows), SCHEMA, 30, 2000))
    assert [b.num_rows for b in got] == [30, 30, 30, 12, 2, 2, 2, 2]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == rows
    assert list(batched(iter([]), SCHEMA, 30)) == []
