"""Components in one task and by rounds, against a plain search."""

import numpy as np
import pytest

from tessera.llm.components import components, smallest


def plain(links):
    up = {x: x for link in links for x in link}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def graphs():
    rng = np.random.default_rng(3)
    ids = np.unique(rng.integers(-(2**63), 2**63 - 1, 400)).tolist()
    path = rng.permutation(ids[:120]).tolist()
    hub = [(ids[199], x) for x in ids[120:199]]  # the largest links all others
    rest = [(ids[i], ids[j]) for i, j in rng.integers(200, len(ids), (150, 2))]
    links = [*zip(path, path[1:], strict=False), *hub, *rest]
    return [(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(links)] + links[:9]


def test_smallest_of_links():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 30, 3000):
        links = rng.integers(-n, n + 1, (n, 2))
        node, label = smallest(links[:, 0], links[:, 1])
        assert dict(zip(node.tolist(), label.tolist(), strict=True)) == plain(links.tolist())


@pytest.mark.parametrize("at_once", [0, 340, 1 << 21])
def test_components_equal_plain_search(spark, at_once):
    links = graphs()
    want = {k: v for k, v in plain(links).items() if any(k in link and link[0] != link[1] for link in links)}
    got = components(spark.createDataFrame(links, "a long, b long"), at_once).collect()
    assert len(got) == len(want) and {r.node: r.label for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long"), at_once).count() == 0
    assert components(spark.createDataFrame([(3, 3)], "a long, b long"), at_once).count() == 0


def test_few_links_take_few_jobs(spark):
    """Each job leaves its threads, stages and tasks with the driver, however few the rows."""
    sc = spark.sparkContext
    links = spark.createDataFrame(graphs(), "a long, b long").repartition(5).cache()
    links.count()
    sc.setJobGroup("few links", "")
    try:
        components(links).collect()
        jobs = sc.statusTracker().getJobIdsForGroup("few links")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        links.unpersist()
    assert 0 < len(jobs) <= 6, len(jobs)
