"""Trees by pointer doubling: random forests, a long chain, a star, cycles and missing parents."""

import random

from loomlog.operators.trees import depths, subtree_sums


def frame(spark, up):
    return spark.createDataFrame([(n, p, 1, n % 7) for n, p in up.items()], "node long, up long, n long, v long")


def by_hand(up):
    def climb(n):
        seen = [n]
        while up[seen[-1]] in up and up[seen[-1]] not in seen:
            seen.append(up[seen[-1]])
        return seen, up[seen[-1]]

    chains = {n: climb(n) for n in up}
    depth = {n: len(seen) for n, (seen, end) in chains.items() if end is None}
    sums = {n: [1, n % 7] for n in up}
    for n, (seen, end) in chains.items():
        if end not in up:  # not on or below a cycle
            for a in seen[1:]:
                sums[a][0] += 1
                sums[a][1] += n % 7
    return depth, {n: tuple(s) for n, s in sums.items()}


def check(spark, up):
    depth, sums = by_hand(up)
    assert {r["node"]: r["depth"] for r in depths(frame(spark, up)).collect()} == depth
    assert {r["node"]: (r["n"], r["v"]) for r in subtree_sums(frame(spark, up), ["n", "v"]).collect()} == sums


def test_forest_with_cycles_and_missing_parents(spark):
    rng = random.Random(8)
    up = {n: rng.choice([None, n - 1, rng.randrange(n)]) if n else None for n in range(120)}
    up |= {200: 201, 201: 202, 202: 200, 203: 201, 204: 203, 300: 300, 400: 999, 401: 400}  # a ring with a tail, a loop, an orphan with a child
    check(spark, up)


def test_star(spark):
    check(spark, {0: None} | {n: 0 for n in range(1, 300)})


def test_chain_of_ten_thousand_takes_linear_rows(spark):
    n = 10_000
    df = spark.range(n).selectExpr("id AS node", "CASE WHEN id > 0 THEN id - 1 END AS up", "1L AS n")
    assert depths(df).where("depth <> node + 1").count() == 0
    sums = subtree_sums(df, ["n"])
    assert sums.count() == n and sums.where(f"n <> {n} - node").count() == 0
