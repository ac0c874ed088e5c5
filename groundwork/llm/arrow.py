"""Reading a partition that is sorted by its group, group by group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, in the order they come; ``keys`` must have no nulls."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        new = None
        for c in cols:
            d = pc.not_equal(c.slice(1), c.slice(0, n - 1))
            new = d if new is None else pc.or_(new, d)
        cuts = [0, *(pc.indices_nonzero(new).to_numpy() + 1).tolist(), n] if n > 1 else [0, n]
        for a, b in zip(cuts, cuts[1:]):
            key = [c[a].as_py() for c in cols]
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
