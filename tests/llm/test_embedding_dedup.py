import numpy as np

from tracelight.llm.common import table
from tracelight.llm.embedding_dedup import embedding_links, hadamard

SCHEMA = "vec_id long, embedding array<float>, label int, c int"


def brute(rows):
    ok, unit = [], []
    for k, v, *_ in rows:
        good = bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(good)
        x = np.array(v, np.float32).astype(float) if good else None
        unit.append(x / np.linalg.norm(x) if good else None)
    n = len(rows)
    near = [[j for j in range(n) if i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        first = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), first, rows[i][0] == first))
    return out


def vectors():
    rng = np.random.default_rng(4)
    out = [rng.normal(size=64) for _ in range(60)]
    for size in (30, 3):
        base = rng.normal(size=64)
        out += [base + rng.normal(size=64) * 0.12 for _ in range(size)]
    out += [out[0], out[0], out[1] * 7, -out[1], np.zeros(64), out[2][:48], out[2][:48] * 2]
    rows = [[float(x) for x in v] for v in out]
    rows += [None, [], [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] * 64, [3.0], [4.0]]
    rows = [(i, v, 0, 1) for i, v in enumerate(rows)]
    return rows + [(3, rows[3][1], 0, 1), (None, rows[4][1], None, None), (None, None, None, None)]


def test_against_brute_force(spark):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(brute(vectors()), key=key)
    for block, part_rows in ((1024, 16_384), (7, 16_384), (1024, 9), (7, 9)):
        got = embedding_links(spark.createDataFrame(vectors(), SCHEMA).repartition(3), block=block, part_rows=part_rows).collect()
        assert sorted((tuple(r) for r in got), key=key) == want


def test_recall_on_the_table(spark, sf_dir):
    data = table(spark, sf_dir, "embeddings").collect()
    x = np.array([r.embedding for r in data], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    # planted near copies of every tenth vector
    rng = np.random.default_rng(8)
    more = x[::10] + rng.normal(size=x[::10].shape) * 0.035
    rows = [(i, [float(v) for v in e], 0, 0) for i, e in enumerate(np.vstack([x, more]))]
    y = np.vstack([x, more]).astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    want = int((y @ y.T >= 0.95).sum()) - len(y)
    got = sum(r.n_links for r in embedding_links(spark.createDataFrame(rows, SCHEMA)).collect())
    assert want > 0 and 0.99 * want <= got <= want


def test_empty(spark):
    assert embedding_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
