import random

from gridloom.llm.islands import hash_to_min


def least(vertices, links):
    up = {v: v for v in vertices if v is not None}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        if a in up and b in up:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {v: find(v) for v in up}


def run(spark, vertices, links, **kw):
    v = spark.createDataFrame([(x, "e") for x in vertices], "id bigint, group_id string")
    e = spark.createDataFrame([(a, b, 1) for a, b in links], "a bigint, b bigint, m int")
    rows = hash_to_min(v, e, **kw).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: r.group_id for r in rows}


def test_against_union_find(spark):
    for seed, n, m in ((1, 60, 50), (2, 60, 90)):
        r = random.Random(seed)
        v = list(range(n)) + [None, 3, 3]
        links = [(r.randrange(n + 3), r.randrange(n + 3)) for _ in range(m)] + [(None, 1), (1, None), (4, 4)]
        links += links[:5] + [(b, a) for a, b in links[5:9]]
        assert run(spark, v, links) == least(v, links)


def test_chain_and_hot_star(spark):
    chain = [(i + 1, i) for i in range(40)]
    star = [(100, 101 + i) for i in range(80)]
    v = list(range(41)) + list(range(100, 181)) + [500]
    got = run(spark, v, chain + star, min_rows=10)
    assert got == least(v, chain + star)


def test_paths_and_shapes(spark):
    """Groups that settle at different rounds, through every way of placing and setting aside."""
    r = random.Random(5)
    links, at = [], 0
    for size in (1, 2, 3, 7, 20, 61):
        ids = list(range(at, at + size))
        r.shuffle(ids)
        links += list(zip(ids, ids[1:]))
        at += size
    links += [(at + i, at + i // 2) for i in range(1, 40)] + [(at + 40 + i, at + 40 + (i + 1) % 9) for i in range(9)]
    v = list(range(at + 50))
    for kw in ({}, {"min_rows": 3}, {"known": True, "min_rows": 20}):
        assert run(spark, v, links, **kw) == least(v, links)


def test_empty(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [5, 6], []) == {5: 5, 6: 6}
    assert run(spark, [], [(1, 2)]) == {}
