"""Vector near-duplicates against all cosines, their recall, and odd rows."""

import math

import numpy as np
import pytest

from shelfwise.llm import embedding_dedup as dedup
from shelfwise.llm.queries import op13_embedding_dedup

SCHEMA = "vec_id bigint, embedding array<double>, label int, cls string, root string, unit string"


def plain_links(rows, threshold=0.9):
    """(id, links, component) of every row, and the number of linked pairs both ways."""
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    units = [dedup.usable(v) for _, v in rows]
    links = [0] * len(rows)
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and float(a @ b) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (vec_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), vec_id), vec_id)
    return sorted((vec_id, links[i], least[find(i)]) for i, (vec_id, _) in enumerate(rows)), sum(links)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", "clash", "clash") for i, v in rows], SCHEMA)


def found(spark, rows, **options):
    got = dedup.near_duplicate_vectors(frame(spark, rows), **options).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got)


def clusters(n, dim, spreads, seed):
    draw = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        centre = draw.standard_normal(dim)
        spread = draw.choice(spreads)
        for _ in range(draw.integers(1, 25)):
            rows.append((len(rows), (centre + draw.standard_normal(dim) * spread).tolist()))
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 64, "window": 16, "tile": 8}])
def test_recall_against_all_cosines(spark, options):
    rows = clusters(40, 24, [0.05, 0.2, 0.3, 0.4], 5)
    want, pairs = plain_links(rows)
    got = found(spark, rows, **options)
    assert sum(r[1] for r in got) >= 0.99 * pairs
    assert all(a[0] == b[0] and a[1] <= b[1] and a[2] >= b[2] for a, b in zip(got, want))  # no false link
    assert sum(a == b for a, b in zip(got, want)) >= 0.97 * len(want)


def test_one_large_group_is_counted_whole(spark):
    draw = np.random.default_rng(1)
    centre = draw.standard_normal(32)
    rows = [(i, (centre + 0.05 * draw.standard_normal(32)).tolist()) for i in range(700)]
    rows += [(700 + i, draw.standard_normal(32).tolist()) for i in range(100)]
    want, _ = plain_links(rows)
    assert found(spark, rows) == want
    assert want[0] == (0, 699, 0)


def test_copies_scales_and_rows_that_link_with_nothing(spark):
    v = [1.0, 2.0, -1.0]
    nothing = [None, [], [0.0] * 3, [1.0, None, 2.0], [math.nan] * 3, [math.inf, 1.0, 1.0]]
    rows = [(9, v), (5, v), (5, v), (7, [2.0 * x for x in v]), (8, [-x for x in v]), (6, v[:2])]
    rows += [(20 + i, x) for i, x in enumerate(nothing)] + [(30, [1e300, 2e300, -1e300]), (31, [1e-300, 2e-300, -1e-300])]
    want = [(5, 5, 5), (5, 5, 5), (6, 0, 6), (7, 5, 5), (8, 0, 8), (9, 5, 5)]
    want += [(20 + i, 0, 20 + i) for i in range(len(nothing))] + [(30, 5, 5), (31, 5, 5)]
    assert found(spark, rows) == want


def test_null_ids(spark):
    got = dedup.near_duplicate_vectors(frame(spark, [(None, [1.0, 0.0]), (3, [1.0, 0.0]), (None, None)])).collect()
    rows = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got)
    assert rows == [("3", 1, "3", True), ("None", 0, "None", True), ("None", 1, "3", False)]


def test_no_links_and_an_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    assert found(spark, rows) == [(0, 0, 0), (1, 0, 1)]
    assert found(spark, []) == []


def test_number_of_passes_follows_from_the_rows():
    counts = [dedup.passes_for(10**k, 0.9) for k in range(1, 10)]
    assert counts[0] == 1 and counts == sorted(counts) and counts[-1] > counts[4]


def test_query_on_given_vectors(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in op13_embedding_dedup(spark, sf_dir).collect())
    assert got == plain_links(rows)[0]
