"""Links of a bucket, block by block, against all pairs."""

import numpy as np
import pytest

from threadloom.llm import near_texts


def components(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("most_sets, most_hashes", [(1024, 1 << 20), (7, 1 << 20), (1024, 150), (3, 60)])
def test_apart_links(spark, most_sets, most_hashes):
    rng = np.random.default_rng(5)
    bases = rng.integers(0, 1 << 62, (6, 40), dtype=np.uint64)
    sets, roots = [], []
    for k in range(90):
        base = bases[k % 6].copy()
        changed = rng.choice(40, rng.integers(0, 7), replace=False)
        base[changed] = rng.integers(0, 1 << 62, len(changed), dtype=np.uint64)
        sets.append(np.unique(base))
        roots.append(5 if k % 4 == 0 and k % 6 == 0 else k)
    bucket = [k % 2 for k in range(90)]
    keys = rng.choice(1 << 60, 90, replace=False)
    # roots are keys; what is of one root already stays so
    rows = [(bucket[k], (int(keys[k]), len(sets[k]), 0), int(keys[roots[k]])) for k in range(90)]
    members = spark.createDataFrame(rows, "bucket long, s struct<key: long, n: long, fp: long>, root long")
    hashes = spark.createDataFrame([(int(k), bytearray(s.astype("<u8").tobytes())) for k, s in zip(keys, sets, strict=True)], "key long, hashes binary")
    got = near_texts.apart_links(members, hashes, 80, most_sets, most_hashes).collect()

    place = {int(k): i for i, k in enumerate(keys)}
    near = [(i, j) for i in range(90) for j in range(i) if bucket[i] == bucket[j] and 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]))]
    told = [(place[r.u], place[r.v]) for r in got]
    assert {tuple(sorted(x)) for x in told} <= {tuple(sorted(x)) for x in near}
    assert all(roots[a] != roots[b] for a, b in told)
    known = [(k, roots[k]) for k in range(90)]
    assert components(90, told + known) == components(90, near + known)
    assert len(told) < len(near)


def test_apart_links_of_nothing(spark):
    members = spark.createDataFrame([], "bucket long, s struct<key: long, n: long, fp: long>, root long")
    assert near_texts.apart_links(members, spark.createDataFrame([], "key long, hashes binary"), 80).count() == 0
