"""Giving memory back between batches leaves what a step yields as it is."""

import numpy as np
import pyarrow as pa

from lodestone.llm.common import give_back, lean


def test_batches_pass_unchanged():
    def step(batches):
        total = 0
        for batch in batches:
            total += batch.num_rows
            yield batch.slice(0, 1)
            yield batch.slice(1)
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["x"])

    given = [pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + n))], ["x"]) for i, n in ((0, 3), (3, 0), (3, 200_000))]
    got = [x for b in lean(step)(iter(given)) for x in b.column(0).to_pylist()]
    assert got == [*range(200_003), 200_003]
    assert list(lean(step)(iter([])))[0].column(0).to_pylist() == [0]
    give_back()
