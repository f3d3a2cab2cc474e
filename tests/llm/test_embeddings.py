"""Embedding near-duplicates against all pairs."""
import math
import pickle
from pathlib import Path

import numpy as np
import pytest

from opslake.llm import embed_dedup
from opslake.llm.components import component_labels
from opslake.session import shared_dir


def brute(rows, cosine=0.95):
    n = len(rows)
    unit = []
    for _, v in rows:
        fine = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if fine else None)
    links = [[b for b in range(n) if b != a and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b])
              and unit[a] @ unit[b] >= cosine - 1e-12] for a in range(n)]
    seen, out = {}, []
    for a in range(n):
        if a not in seen:
            todo, group = [a], {a}
            while todo:
                for b in links[todo.pop()]:
                    if b not in group:
                        group.add(b)
                        todo.append(b)
            ids = [rows[g][0] for g in group if rows[g][0] is not None]
            seen.update(dict.fromkeys(group, min(ids) if ids else None))
    for a, (i, _) in enumerate(rows):
        out.append((i, len(links[a]), seen[a], i == seen[a] if i is not None and seen[a] is not None else i is None and seen[a] is None))
    return out


def hostile(seed=4, n=300):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, 8))
    rows = [(int(i), (centres[i % 6] + rnd.normal(size=8) * rnd.choice([0.05, 0.3, 1.0])).tolist()) for i in rnd.permutation(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(5, rows[5][1]), (None, rows[7][1]), (None, [9.0] * 8)]
    return rows + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, None] + [0.0] * 6), (2004, [math.inf] + [1.0] * 7), (2005, []),
                   (2006, [1.0, 2.0, 3.0]), (2007, [2.0, 4.0, 6.0]), (2008, [1e-200] * 8), (2009, [1e200] * 8)]


@pytest.mark.parametrize("chunk", [16, 4096])
def test_near_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(embed_dedup, "CHUNK", chunk)
    rows = hostile()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, node int, n_links string").repartition(3)
    got = embed_dedup.near_vectors(df).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    # The tiny and the huge vector point one way and link, though their norms leave the range of doubles.
    want = [r for r in brute(rows) if r[0] not in (2008, 2009, None)]
    assert sorted((tuple(r) for r in got if r[0] not in (2008, 2009, None)), key=key) == sorted(want, key=key)
    assert len(got) == len(rows)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_tree_bounds_hold():
    rnd = np.random.default_rng(2)
    v = rnd.normal(size=(500, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tree = embed_dedup.CoverTree(v, 64, 0.05)
    node = tree.cell
    for level in range(len(tree.sizes) - 1, -1, -1):
        d = embed_dedup.distances(v, tree.centres[:tree.sizes[level]])[np.arange(len(v)), node]
        assert (d <= tree.radii[level][node] + 1e-7).all()
        node = tree.parents[level - 1][node] if level else node
    a, b = embed_dedup.CoverTree(v[:250], 32, 0.01), embed_dedup.CoverTree(v[250:], 32, 0.01)
    alive = embed_dedup.close_cells(a, b, 0.3)
    i, j = np.nonzero(embed_dedup.distances(v[:250], v[250:]) <= 0.3)
    assert alive[a.cell[i], b.cell[j]].all() and not alive.all()


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 300)] + [(7, 7), (None, 3), (400, 400)]
    got = dict(map(tuple, component_labels(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 300)}}


def stored(spark):
    """Bytes of the shuffle files and below the shared folder."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    shared = Path(shared_dir(spark).removeprefix("file:"))
    return sum(files.apply(k).length() for k in range(files.size())) + sum(p.stat().st_size for p in shared.rglob("*.parquet"))


def test_pairs_of_chunks_are_not_stored(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CHUNK", 32)
    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(1500, 64)).astype(np.float32)
    v = np.concatenate([v, v[:100] + np.float32(0.02) * rnd.normal(size=(100, 64)).astype(np.float32), v[:50]])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>").repartition(4)
    most = []

    def labels(links):
        most.append(stored(spark))
        return component_labels(links)

    monkeypatch.setattr(embed_dedup, "component_labels", labels)
    before = stored(spark)
    got = sorted(map(tuple, embed_dedup.near_vectors(df).collect()))
    assert most[0] - before < 12 * v.nbytes  # 47 chunks without any structure: every pair of them has to be met
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    assert got == [(i, int(near[i].sum()) - 1, int(near[i].argmax()), bool(near[i].argmax() == i)) for i in range(len(v))]


def test_sketches_lose_no_link():
    rnd = np.random.default_rng(8)
    v = (rnd.normal(size=(400, 40)) * rnd.choice([0.1, 1.0, 3.0], size=40)).astype(np.float32)
    v[200:] = v[:200] + rnd.normal(size=(200, 40)).astype(np.float32) * rnd.choice([0.1, 0.3, 0.6], size=(200, 1)).astype(np.float32)
    unit = embed_dedup._units(v)
    axes = embed_dedup._axes(unit)
    chunks = []
    for part in (v[:200], v[200:]):
        tree = embed_dedup.CoverTree(embed_dedup._units(part), 16, 0.05)
        order = np.argsort(tree.cell, kind="stable")
        place = np.argsort(order)
        blob = pickle.dumps((tree.cell[order], place[tree.order], tree.sizes, tree.radii[-1]))
        chunks.append((embed_dedup.Chunk(len(chunks) << 13, np.ones(200, np.int64).tobytes(), part[order].tobytes(), blob, 40, "float32", axes), order))
    (a, first), (b, second) = chunks
    near = embed_dedup._units(v[:200])[first] @ embed_dedup._units(v[200:])[second].T >= 0.95
    ids, linked, _ = embed_dedup.compare(a, b, False, 0.95)
    want = dict(zip(a.ids.tolist(), near.sum(axis=1).tolist())) | dict(zip(b.ids.tolist(), near.sum(axis=0).tolist()))
    assert dict(zip(ids.tolist(), linked.tolist())) == {k: n for k, n in want.items() if n} and len(ids)
