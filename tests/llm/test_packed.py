import numpy as np

from panelforge.llm.packed import Layout, runs, spans


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    layout = Layout(a="i8", b="u4", c="u1")
    blocks = [{"a": rng.integers(-(1 << 62), 1 << 62, n), "b": rng.integers(0, 1 << 32, n).astype(np.uint32), "c": rng.integers(0, 2, n).astype(np.uint8)} for n in (5, 0, 1, 300)]
    out = layout.unpack(map(layout.pack, blocks))
    for name, kind in (("a", "i8"), ("b", "u4"), ("c", "u1")):
        assert out[name].dtype == np.dtype(kind) and (out[name] == np.concatenate([b[name] for b in blocks])).all()
    assert all(len(x) == 0 for x in layout.unpack([]).values())


def test_runs_and_spans():
    assert list(runs(np.array([3, 3, 5, 7, 7]))) == [(3, 0, 2), (5, 2, 3), (7, 3, 5)] and list(runs(np.array([], int))) == []
    assert spans(np.array([4, 9, 0]), np.array([2, 0, 3])).tolist() == [4, 5, 0, 1, 2]
