"""The visits of a batch of queries leave a task in small pieces, however many rings each query looks at."""

import numpy as np
import pyarrow as pa

from larkspur.operators.nearest import Rings, _visits


class Planned:
    """Stands for the queries and hands out the function that would run in the tasks."""

    def mapInArrow(self, plan, schema):  # noqa: N802
        return plan


def test_visits_leave_in_small_batches():
    n, width, cells, per_cell = 900, 2, 16, 8
    rng = np.random.default_rng(3)
    cell, rings = np.repeat(np.arange(cells), per_cell), cells * per_cell
    blocks = rng.integers(1, 4, rings)
    known = Rings(width, rng.normal(size=(cells, width)), cell, np.zeros(rings), np.full(rings, 9.0), np.full(rings, 50), np.cumsum(blocks) - blocks, blocks)
    asked = pa.record_batch([pa.array(range(n)), pa.array(rng.normal(size=(n, width)).tolist()), pa.array([float("inf")] * n)], ["query_id", "v", "limit"])
    seen = []
    for further in (False, True):
        for b in _visits(Planned(), known, 60, further)(iter([asked])):
            assert b.num_rows <= 10_000 and b.nbytes < 1 << 20
            assert b["v"].to_pylist() == [asked["v"][q].as_py() for q in b["query_id"].to_pylist()]
            seen += zip(b["query_id"].to_pylist(), b["block"].to_pylist(), strict=True)
    assert sorted(seen) == [(q, b) for q in range(n) for b in range(blocks.sum())]  # both steps together: each block once
