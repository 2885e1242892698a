import random

import pytest
import xxhash

from quire.llm import simhash
from quire.llm.components import components

from .fixtures import documents, prose


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, radius):
    """Component of each value by comparing all pairs."""
    up = list(range(len(values)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                up[top(i)] = top(j)
    return [top(i) for i in range(len(values))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_documents(spark):
    base = prose(1, 300)
    near = [base.replace(base.split()[k], "changed") for k in (5, 50, 100)]
    rows = [(7, base), (3, near[0]), (9, near[1]), (8, near[2]), (2, None), (5, ""), (4, " \n"), (6, "one"), (1, "ONE"), (10, "Éa b c"), (7, base), (None, base), (11, prose(9, 20_000))]
    found = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    values = [fingerprint(t) for _, t in rows]
    top = roots(values, 2)
    least = {t: min(i for (i, _), x in zip(rows, top, strict=True) if x == t and i is not None) for t in top}
    assert found == {(i, signed(v), least[t]) for (i, _), v, t in zip(rows, values, top, strict=True)}
    kept = simhash.keep_one(documents(spark, rows))
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(set(least.values()))
    assert kept.columns == documents(spark, rows).columns
    assert simhash.near_duplicates(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_lose_no_connection(spark, radius):
    chance = random.Random(radius)
    values = [chance.getrandbits(64) for _ in range(30)]
    for _ in range(120):
        v = chance.choice(values)
        for bit in chance.sample(range(64), chance.randrange(5)):
            v ^= 1 << bit
        values.append(v)
    values = list(dict.fromkeys(values))
    links = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fingerprint long"), radius)
    pairs = [(r.a, r.b) for r in links.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= radius for a, b in pairs)
    found = {r.node: r.root for r in components(links).collect()}
    groups, expected = {}, {}
    for v, t in zip(values, roots(values, radius), strict=True):
        groups.setdefault(found.get(signed(v), signed(v)), set()).add(v)
        expected.setdefault(t, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_path_a_star_and_nothing(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1001 + k) for k in range(50)] + [(5, 5), (None, 3), (1, 0)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(51)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_are_spread_before_they_become_variants(spark, tmp_path):
    rows = spark.createDataFrame([(k,) for k in (1, 2, 2, 3)], "fingerprint long").groupBy("fingerprint").count()
    links = simhash.links(rows.select("fingerprint"))
    plan = links._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Generate explode") :]
    assert "xxhash64(fingerprint" in below and "REPARTITION_BY_NUM" in below, plan
