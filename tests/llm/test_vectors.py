import numpy as np
import pytest

from lodestone.llm import partitions, pq


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v], "l") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, n_links string")


def awkward(seed=0, n=1500):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 32)).astype(np.float32)
    x[100:200] = x[0] + 0.15 * rng.standard_normal((100, 32))
    x[200:260] = x[1]
    x[260:270] = x[1] * 3
    x[300:330] = x[299] + 0.08 * np.cumsum(rng.standard_normal((30, 32)), 0)
    ids = rng.permutation(10 * n)[:n]
    rows = list(x)
    rows[5], rows[6], rows[7], rows[8], rows[9] = None, [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [1.0] * 7
    return ids, rows


def good(ids, rows):
    keep = [k for k, v in enumerate(rows) if v is not None and len(v) == 32 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    return ids[keep], np.array([rows[k] for k in keep], np.float64)


def test_links_and_components_against_brute_force(spark):
    ids, rows = awkward()
    names, x = good(ids, rows)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    label = names.copy()
    while True:
        fresh = np.array([min(label[k], label[linked[k]].min(initial=label[k])) for k in range(len(label))])
        if (fresh == label).all():
            break
        label = fresh
    expected = {int(i): (0, int(i)) for i in ids} | {int(i): (int(n), int(c)) for i, n, c in zip(names, linked.sum(1), label, strict=True)}
    for reach in (None, pq.REACH):
        got = pq.near_vectors(table(spark, ids, rows), reach=reach).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == expected and len(got) == len(ids)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_search_reaches_the_recall(spark):
    ids, rows = awkward(1, 6000)
    names, x = good(ids, rows)
    df = table(spark, ids, rows)
    got = partitions.search(df, df.where("vec_id % 20 = 0")).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for k in np.flatnonzero(names % 20 == 0):
        scores = (x * x[k]).sum(1)
        best = [j for j in np.lexsort((names, -scores)) if j != k][:20]
        mine = found[int(names[k])]
        assert mine == sorted(mine, key=lambda p: (-p[1], p[0])) and len(mine) == 20 and int(names[k]) not in dict(mine)
        assert all(abs(s - scores[np.flatnonzero(names == i)[0]]) < 1e-12 * max(1, abs(s)) for i, s in mine)
        hits += len({int(names[j]) for j in best} & set(dict(mine)))
        total += 20
    assert set(found) == {int(i) for i in names if i % 20 == 0}
    assert hits >= 0.9 * total


def test_search_in_parts_that_are_cut_again(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 24)) * 2
    x = (centres[rng.integers(0, 40, 5000)] + rng.standard_normal((5000, 24)) * 0.4).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = partitions.search(df, df.where("vec_id % 20 = 0"), split_above=40).collect()
    mine: dict[int, set] = {}
    for r in got:
        mine.setdefault(r.query_id, set()).add(r.vec_id)
    assert {len(v) for v in mine.values()} == {20} and len(mine) == 250
    hits = sum(len(mine[k] & {int(j) for j in np.argsort(-(x @ x[k]))[:21] if j != k}) for k in mine)
    assert hits >= 0.85 * 20 * len(mine)


def test_ties_go_to_smaller_ids_and_few_rows(spark):
    df = table(spark, [20, 3, 2, 40, 5], [[1, 0], [1, 0], [1, 0], [2, 0], [-1, 0]])
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in partitions.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 40, 2.0), (20, 2, 2, 1.0), (20, 3, 3, 1.0), (20, 4, 5, -1.0), (40, 1, 2, 2.0), (40, 2, 3, 2.0), (40, 3, 20, 2.0), (40, 4, 5, -2.0)]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    df = table(spark, [20][:n], [[1, 0]][:n])
    assert partitions.search(df, df).count() == 0
    assert pq.near_vectors(df).count() == n


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((8, 16)) * 4, 100, 0) + rng.standard_normal((800, 16)) * 0.3
    graph = partitions.neighbour_graph(x, 10)
    label = partitions.balanced_parts(x, graph, 8)
    assert np.bincount(label, minlength=8).max() <= np.ceil(1.1 * 100)
    assert (label[graph] == label[:, None]).mean() > 0.6


def test_codes_bound_distances():
    rng = np.random.default_rng(3)
    x = pq.unit(rng.standard_normal((2000, 24)))
    index = pq.Index(x, len(x), 0.2**0.5)
    home, codes, error = index.place(x)
    cell = int(home[0])
    rows = np.flatnonzero(home == cell)
    rough = np.sqrt(index.distances(x[:50], index.centres[cell], codes[rows]))
    exact = np.sqrt(((x[:50, None] - x[None, rows]) ** 2).sum(2))
    assert (np.abs(rough - exact) <= error[rows] + 1e-4).all()


def low_rank(rank=3, n=6000, dims=64):
    rng = np.random.default_rng(11)
    return rng.standard_normal((n, rank)) @ rng.standard_normal((rank, dims)) + 0.02 * rng.standard_normal((n, dims))


def uneven(n=6000, dims=64):
    """A 1/k spectrum, every other row near another one."""
    rng = np.random.default_rng(13)
    scale = np.sqrt(1 / np.arange(1, dims + 1))
    x = rng.standard_normal((n, dims)) * scale
    x[1::2] = x[::2] + rng.standard_normal((n // 2, dims)) * scale * 0.5 * rng.random((n // 2, 1))
    return x


def planted(n=6000, dims=64):
    """Even in all directions, every tenth row near another one."""
    rng = np.random.default_rng(14)
    x = rng.standard_normal((n, dims))
    x[::10] = x[1::10] + rng.standard_normal((n // 10, dims)) * 0.6 * rng.random((n // 10, 1))
    return x


@pytest.mark.parametrize("made", [low_rank, uneven, planted])
def test_links_found_of_all_links(spark, made):
    x = made().astype(np.float32).astype(np.float64)
    ids = np.random.default_rng(12).permutation(len(x))
    u = pq.unit(x)
    expected = (u @ u.T >= 0.9).sum(1) - 1
    rows = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<float>")
    for reach, least in ((pq.REACH, 0.999), (None, 1.0)):
        got = {r.vec_id: r.n_links for r in pq.near_vectors(rows, reach=reach).collect()}
        assert all(got[int(i)] <= n for i, n in zip(ids, expected, strict=True))
        assert sum(got.values()) >= least * expected.sum() > 0


@pytest.mark.parametrize("reach", [pq.REACH, None])
def test_large_lists_are_split_once_more(spark, reach):
    x = uneven(3000).astype(np.float32).astype(np.float64)
    u = pq.unit(x)
    expected = (u @ u.T >= 0.9).sum(1) - 1
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in pq.near_vectors(rows, reach=reach, split_above=60).collect()}
    assert all(got[i] <= n for i, n in enumerate(expected)) and sum(got.values()) >= (0.998 if reach else 1.0) * expected.sum() > 0


def test_probes_are_few_and_search_scans_few_rows(spark):
    """The figures that the README gives, with their bounds: shares of the rows that a vector or a query is compared with."""
    for n in (10_000, 50_000):
        x = planted(n)
        sample = x[np.random.default_rng(1).permutation(n)[: pq.SAMPLE_ROWS]]
        index = pq.Index(pq.unit(sample), n, 0.2**0.5)
        home, _, _ = index.place(pq.unit(x))
        share = (index.probes(pq.unit(x[:2000]), home[:2000]) * np.bincount(home, minlength=len(index.centres))).sum(1).mean() / n
        parts = partitions.Parts(np.arange(len(sample)), sample, n, 20, partitions.RECALL)
        of = parts.route(x, 1)[:, 0]
        q = x[:400]
        visited = parts.route(q, parts.visits)
        scanned = np.bincount(of, minlength=parts.parts)[visited].sum(1).mean() / n
        true = np.argsort(-(q @ x.T), axis=1)[:, 1:21]
        recall = np.mean([np.isin(of[t], v).mean() for t, v in zip(true, visited, strict=True)])
        print(f"{n} rows: {len(index.centres)} lists, {share:.3f} of the rows probed; {parts.parts} parts, {parts.visits} visited, {scanned:.3f} of the rows scanned, recall {recall:.3f}")
        assert share < 0.15 and scanned < 0.65 and recall >= 0.9


def test_the_queries_themselves(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    links = pq.op10_pq(spark, sf)
    assert links.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert {r.vec_id for r in links.collect()} == {r.vec_id for r in rows}
    found = partitions.op6_partitions(spark, sf)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert {(r.query_id, r.rank) for r in found.collect()} == {(r.vec_id, k) for r in rows if r.vec_id % 20 == 0 for k in range(1, 21)}
