"""Work and range of the nearest-neighbour search within one block."""

import numpy as np
import pyarrow as pa

from sitewise.llm import nearest


def found(data, asked, k):
    ids = np.arange(len(data))
    tables = [pa.table({name: i, "embedding": list(data[i])}) for name, i in (("vec_id", ids), ("query_id", asked))]
    out = nearest._search(k, data.mean(axis=0), nearest.rotation(data.shape[1]))(*tables)
    return {i: [x.as_py() for x, q in zip(out["vec_id"], out["query_id"], strict=True) if q.as_py() == i] for i in asked.tolist()}


def brute(data, i, k):
    score = (data * data[i]).sum(axis=1)
    score[i] = -np.inf
    return np.lexsort((np.arange(len(data)), -score))[:k].tolist()


def test_few_vectors_are_scored_exactly(monkeypatch):
    data = np.random.default_rng(5).standard_normal((4000, 32))
    data[100:140] = data[7]  # ties go to the smaller id
    asked, scored, sort = np.array([7, 50, 120, 3999]), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: scored.append(len(keys[0])) or sort(keys))
    got = found(data, asked, 20)
    assert len(scored) == len(asked) and max(scored) <= 400  # nearly all 4,000 before
    assert all(got[i] == brute(data, i, 20) for i in got)


def test_lengths_beyond_single_precision():
    for size in (1e-60, 1e60):
        data = np.random.default_rng(6).standard_normal((300, 8)) * size
        asked = np.array([0, 20])
        assert all(x == brute(data, i, 5) for i, x in found(data, asked, 5).items())
