import tracemalloc

import pyarrow as pa
import pytest

from quartzframe.operators import structured

QUAD = [(100.0, 100.0), (900.0, 100.0), (900.0, 700.0), (100.0, 700.0)]


@pytest.mark.parametrize("objective", ["minimax", "sum"])
def test_a_large_batch_is_read_a_few_groups_at_a_time(objective):
    """All options of a batch were Python objects at once before: over 50 MB for these groups, gigabytes for a batch of 10,000."""
    corners = [{"x": x, "y": y} for x, y in QUAD]
    option = lambda e, k: {"edge": e, "place": k + 1, "option": f"{e}{k}", "corners": corners, "anchor": corners, "risk": k / 10, "upper": k / 10, "support": 1.0}
    options = pa.array([[option(e, k) for e in range(4) for k in range(6)]] * 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), options], names=["g", "options"])
    tracemalloc.start()
    groups = [g for b in structured.proposals(iter([batch]), ["g"], 1000.0, 800.0, 6, objective) for g in b.column("g").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert groups == list(range(1000))
    assert peak < 15e6
