"""Large JSON texts pass through Python some MB at a time."""

import json
import tracemalloc

import pyarrow as pa

from biblio_spark.plans import record_queries
from biblio_spark.sources import json_members


def peak_and_sizes(batches):
    """(bytes that Python and Arrow hold at most, those of the batches) while batches pass."""
    before, sizes, most = pa.total_allocated_bytes(), [], 0
    tracemalloc.start()
    for batch in batches:
        sizes.append(sum(len(x.as_py() or "") for x in batch.column(batch.num_columns - 1)))
        most = max(most, pa.total_allocated_bytes() - before)
    top = tracemalloc.get_traced_memory()[1] + most
    tracemalloc.stop()
    return top, sizes


def test_a_written_text_is_not_copied_whole():
    rows = [json.dumps({"uid": k, "text": "x" * 3000}) for k in range(9000)]
    batch = pa.RecordBatch.from_pydict({"value": rows})
    parts = [batch.slice(0, 0), batch.slice(0, 1), batch.slice(1, 0), batch.slice(1)]
    top, sizes = peak_and_sizes(record_queries._one_text("hits")(iter(parts)))
    assert top < batch.nbytes / 3 and max(sizes) < 2_000_000
    text = "\n".join(x for b in record_queries._one_text("hits")(iter(parts)) for x in b.column("value").to_pylist())
    assert json.loads(text)["hits"] == [json.loads(r) for r in rows]
    assert json.loads("\n".join(x for b in record_queries._one_text("hits")(iter([])) for x in b.column("value").to_pylist()))["hits"] == []


class _Kept:
    """Takes the function of mapInArrow, to run it here."""

    def mapInArrow(self, run, schema):
        return run


def test_members_leave_their_range_in_parts(tmp_path):
    rows = [{"uid": k, "text": "y" * 3000} for k in range(2500)]
    (tmp_path / "one.json").write_text(json.dumps(rows))
    size = (tmp_path / "one.json").stat().st_size
    placed = pa.RecordBatch.from_pylist([{"path": str(tmp_path / "one.json"), "start": 0, "stop": size, "begin": 0, "parity": 0, "depth": 0, "level": 1}])
    out = list(json_members._members(_Kept())(iter([placed])))
    assert max(sum(len(t or "") for t in b.column("text").to_pylist()) for b in out) < 2 * json_members.MORE
    assert [json.loads(t) for b in out for t in b.column("text").to_pylist() if t] == rows
