"""What a task of the recogniser holds follows neither the batch nor the dictionary."""

import pyarrow as pa

from quillgraph.operators import linking as l


def test_hits_are_handed_on(monkeypatch):
    monkeypatch.setattr(l, "HELD_HITS", 10)
    texts = ["alpha (beta) alphabet gamma-beta " * 2 + "beta"] * 40 + ["", "none"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["chunk_id", "text"])
    got = list(l._hits(batch, l._automaton(["alpha", "beta"])))
    assert len(got) == 20 and max(x.num_rows for x in got) == 10
    rows = [tuple(r.values()) for x in got for r in x.to_pylist()]
    one = [(0, 5, "alpha", "alpha"), (7, 11, "beta", "beta"), (33, 38, "alpha", "alpha"), (40, 44, "beta", "beta"), (66, 70, "beta", "beta")]
    assert rows == [(n, *x) for n in range(40) for x in one]
    assert [x for x in l._hits(batch.slice(40), l._automaton(["alpha"]))] == []
