"""Recall, round trips and additions of the approximate indexes."""

import numpy as np
import pytest

from fathom.operators import vector_indexes
from fathom.operators.vector_indexes import CodedIndex, LayeredIndex, code_books, layers_of, walk

SCHEMA = "id long, v array<double>"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = np.tanh(rng.normal(size=(4000, 8)) @ rng.normal(size=(8, 32))) + 0.1 * rng.normal(size=(4000, 32))
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 32), (None, [1.0] * 32), (9003, [float("inf")] * 32)]
    return x, spark.createDataFrame(rows + odd, SCHEMA).repartition(4)


def recall(found, x, k, step=50):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    own = {}
    for r in found:
        own.setdefault(r.a, []).append((r["rank"], r.b, r.score))
    hits = 0
    for i in range(0, len(x), step):
        s = u @ u[i]
        rows = sorted(own[i])
        assert [r[0] for r in rows] == list(range(1, k + 1)) and all(abs(s[b] - v) < 1e-5 and b != i for _, b, v in rows)
        s[i] = -2
        hits += len({b for _, b, _ in rows} & set(np.argsort(-s)[:k].tolist()))
    return hits / (k * len(own))


def test_coded_index(spark, data, tmp_path, monkeypatch):
    """Recall grows with lists probed; a saved index, and one that was added to, answer alike; lists meet their queries in blocks."""
    x, df = data
    monkeypatch.setattr(vector_indexes, "BLOCK", 300)
    asked = df.where("id % 50 = 0")
    index = CodedIndex.build(df, "id", "v", lists=20)
    assert index.rows.count() == 4000 and index.rows.selectExpr("max(length(code))").first()[0] == 8
    few, some = (recall(index.search(asked, "id", "v", 10, probe=p).collect(), x, 10) for p in (1, 8))
    assert few < some and some >= 0.9
    every = index.search(asked, "id", "v", 10, probe=20, rerank=400).collect()
    assert recall(every, x, 10) == 1.0
    half = CodedIndex.build(df.where("id < 2000"), "id", "v", lists=20).add(df.where("id >= 2000 or id is null"), "id", "v")
    half.save(str(tmp_path / "coded"))
    back = CodedIndex.load(spark, str(tmp_path / "coded"))
    assert back.rows.count() == 4000 and recall(back.search(asked, "id", "v", 10).collect(), x, 10) >= 0.9
    with pytest.raises(ValueError, match="no vectors"):
        CodedIndex.build(df.limit(0), "id", "v")


def test_layered_index(spark, data, tmp_path):
    """Recall grows with the beam; shards merge; what is added is found without a rebuild, and compacted."""
    x, df = data
    asked = df.where("id % 50 = 0")
    index = LayeredIndex.build(df.where("id < 3500"), "id", "v", shard=1000)
    first = index.rows.select("shard").distinct().count()
    index = index.add(df.where("id between 3500 and 3800"), "id", "v").add(df.where("id > 3800 or id is null"), "id", "v")
    assert index.rows.count() == 4000 and index.rows.select("shard").distinct().count() == first + 2
    narrow, wide = (recall(index.search(asked, "id", "v", 10, ef=e).collect(), x, 10) for e in (11, 100))
    assert narrow <= wide and wide >= 0.95
    small = index.compact()
    assert small.rows.count() == 4000 and small.rows.select("shard").distinct().count() == first + 1
    small.save(str(tmp_path / "layers"))
    assert recall(LayeredIndex.load(spark, str(tmp_path / "layers")).search(asked, "id", "v", 10, block=30).collect(), x, 10) >= 0.95
    empty = LayeredIndex.build(df.limit(0), "id", "v")
    assert empty.search(asked, "id", "v", 5).count() == 0 and empty.add(df.where("id < 3"), "id", "v").search(asked.where("id = 0"), "id", "v", 5).count() == 2


def test_layers_reach_every_node(data):
    x = data[0][:800] / np.linalg.norm(data[0][:800], axis=1, keepdims=True)
    top, links = layers_of(np.arange(800), x, 8)
    assert top.max() >= 1 and all(len(own) == t + 1 for own, t in zip(links, top)) and all(len(own[0]) <= 32 for own in links)
    found = sum(i in walk(x[i], x, top, links, 20)[0] for i in range(800))
    assert found >= 790


def test_code_books_cut_errors(data):
    x = data[0][:1000]
    books = code_books(x, 5, 64)
    assert [b.shape[1] for b in books] == [6, 6, 7, 6, 7]
    ends = np.cumsum([0, *[b.shape[1] for b in books]])
    error = sum(((x[:, None, ends[p] : ends[p + 1]] - b[None]) ** 2).sum(2).min(1).sum() for p, b in enumerate(books))
    assert error < 0.5 * ((x - x.mean(0)) ** 2).sum()
