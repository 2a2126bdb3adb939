"""The order of a tree: common prefixes, depth by density, and every pair once."""

import numpy as np

from tidemark.llm import neardup


def region(n, values, seed=1):
    g = np.random.default_rng(seed)
    rows = np.concatenate([np.full((n, neardup.BASE_DEPTH), 7), g.integers(0, values, (n, neardup.DEPTH - neardup.BASE_DEPTH))], axis=1)
    return rows[np.lexsort(rows.T[::-1])]


def pairs_of(prefix, n, leaf):
    for depth, lo, hi, inner in neardup.visits(prefix, 0, n, neardup.BASE_DEPTH, leaf):
        if not inner:
            yield from ((depth, i, j) for i in range(lo, hi) for j in range(i + 1, hi))
        for k, (a, b) in enumerate(inner):
            yield from ((depth, i, j) for i in range(a, b) for c, d in inner[k + 1 :] for j in range(c, d))


def test_prefixes_of_neighbours():
    rows = np.array([[1, 2, 3], [1, 2, 3], [1, 2, 4], [1, 9, 4], [2, 9, 4]])
    assert neardup.common_prefixes(rows).tolist() == [0, 3, 2, 1, 0] and neardup.common_prefixes(rows[:0]).tolist() == []


def test_depth_follows_density():
    sparse, dense = region(20, 3), region(600, 3)
    depths = lambda x: {d for d, _, _, inner in neardup.visits(neardup.common_prefixes(x), 0, len(x), neardup.BASE_DEPTH) if not inner}
    assert depths(sparse) == {neardup.BASE_DEPTH} and min(depths(dense)) > neardup.BASE_DEPTH
    leaves = [hi - lo for _, lo, hi, inner in neardup.visits(neardup.common_prefixes(dense), 0, 600, neardup.BASE_DEPTH) if not inner]
    assert sum(leaves) == 600 and max(leaves) <= neardup.LEAF


def test_every_pair_is_met_once_and_longer_prefixes_first():
    for n, values, leaf in ((1, 2, 4), (90, 2, 4), (90, 1, 4), (60, 5, 64)):
        x = region(n, values)
        prefix = neardup.common_prefixes(x)
        met = list(pairs_of(prefix, n, leaf))
        assert sorted((i, j) for _, i, j in met) == [(i, j) for i in range(n) for j in range(i + 1, n)]
        assert all((x[i][:d] == x[j][:d]).all() for d, i, j in met)


def test_a_dense_region_is_solved_whole():
    """900 sets around ten centres, all in one region: the links found connect what brute force connects."""
    r = np.random.default_rng(4)
    centres = [r.integers(0, 1 << 62, 120, dtype=np.uint64) for _ in range(10)]
    sets = []
    for k in range(900):
        c = centres[k % 10].copy()
        c[r.choice(120, int(r.integers(0, 9)), replace=False)] = r.integers(0, 1 << 62, 1, dtype=np.uint64)
        sets.append(np.unique(c))
    signer = neardup.Signer()
    sig = np.stack([np.frombuffer(signer.signature(s), dtype=">u2").astype(np.int64) for s in sets])
    tree = 3
    sig[:, tree * 8 : tree * 8 + neardup.BASE_DEPTH] = 5
    order = np.lexsort(sig[:, tree * 8 : tree * 8 + 8].T[::-1])
    sets, sig = [sets[i] for i in order], sig[order]
    got, want = neardup.Forest(900), neardup.Forest(900)
    names = [str(i).encode() for i in range(900)]
    links = list(neardup.solve(names, sig, sets, tree))
    for a, b in links:
        got.join(int(a), int(b))
    for i in range(900):
        for j in range(i):
            if neardup.linked(sets[i], sets[j]):
                want.join(i, j)
    assert [got.top(i) for i in range(900)] == [want.top(i) for i in range(900)] and len(links) < 900
