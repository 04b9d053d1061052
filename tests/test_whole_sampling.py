"""Queries over whole samplings: every node, a customer's or not, with the balance of the customer there."""

import math

import pytest

from sphereframe.plans.catalog import all_queries
from sphereframe.plans.views import Tables

CUSTOMERS = 20  # 7 are missing: nodes without a customer are part of every sampling


@pytest.fixture(scope="module")
def sparse(spark, tmp_path_factory):
    """Customers 1 to 27 without every fourth, and none of them at the end of the sampling."""
    path = tmp_path_factory.mktemp("sparse")
    rows = [(k, f"c{k}", k % 3, 100.0 * k, "X") for k in range(1, 28) if k % 4]
    spark.createDataFrame(rows[:CUSTOMERS], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    return Tables(spark, str(path))


def result(sparse, name):
    return all_queries()[name].build(sparse)


ROWS, COLUMNS = 4, 8  # the smallest 1:2 grid with more cells than customers


def test_grid_equiangular(sparse):
    rows = result(sparse, "grid_equiangular").collect()
    assert sorted({r.node for r in rows}) == list(range(ROWS * COLUMNS))
    assert {r.node for r in rows if r.balance is None} == set(range(ROWS * COLUMNS)) - {k for k in range(1, 27) if k % 4}
    assert sum(r.area for r in rows) == pytest.approx(4 * math.pi)


def test_grid_healpix(sparse):
    rows = result(sparse, "grid_healpix").collect()
    assert sorted({r.node for r in rows}) == list(range(48))
    assert {r.node for r in rows if r.balance is None} == set(range(48)) - {k for k in range(1, 27) if k % 4}


def test_grid_cubed(sparse):
    rows = result(sparse, "grid_cubed").collect()
    assert sorted(r.node for r in rows) == list(range(24))
    assert sum(r.balance is None for r in rows) == 24 - 18


def test_grid_random(sparse):
    rows = result(sparse, "grid_random").collect()
    assert sorted(r.node for r in rows) == list(range(CUSTOMERS + 1))
    assert {r.node for r in rows if r.balance is None} == {0, 4, 8, 12, 16, 20}


def test_area_weights(sparse):
    rows = result(sparse, "area_weights").collect()
    assert sorted({r.node for r in rows}) == list(range(ROWS * COLUMNS))
    assert {r.node for r in rows if r.balance is None} == set(range(ROWS * COLUMNS)) - {k for k in range(1, 27) if k % 4}
    assert all(r.weight == pytest.approx(r.area / (4 * math.pi)) for r in rows)


def test_polygon_areas(sparse):
    rows = result(sparse, "polygon_areas").collect()
    assert sorted({r.node for r in rows}) == list(range(ROWS * COLUMNS))
    assert {r.node for r in rows if r.balance is None} == set(range(ROWS * COLUMNS)) - {k for k in range(1, 27) if k % 4}
    assert sum(r.area for r in rows) == pytest.approx(4 * math.pi)


def test_node_ij(sparse):
    rows = result(sparse, "node_ij").collect()
    assert sorted({r.node for r in rows}) == list(range(ROWS * COLUMNS))
    assert {r.node for r in rows if r.balance is None} == set(range(ROWS * COLUMNS)) - {k for k in range(1, 27) if k % 4}
    assert all(r.node == r.i * COLUMNS + r.j for r in rows)


def test_parent_map_grid(sparse):
    rows = result(sparse, "parent_map_grid").collect()
    assert sorted({r.node for r in rows}) == list(range(ROWS * COLUMNS))
    assert {r.node for r in rows if r.balance is None} == set(range(ROWS * COLUMNS)) - {k for k in range(1, 27) if k % 4}
    assert sorted({r.parent for r in rows}) == list(range(ROWS * COLUMNS // 4))


def test_overlap_weights(sparse):
    rows = result(sparse, "overlap_weights").collect()
    assert {r.src for r in rows} == set(range(ROWS * COLUMNS))
    assert {r.src for r in rows if r.balance is None} == set(range(ROWS * COLUMNS)) - {k for k in range(1, 27) if k % 4}
    assert sum(r.w for r in rows) == pytest.approx(4 * math.pi)


def test_pool_matrix(sparse):
    rows = result(sparse, "pool_matrix").collect()
    assert {r.src for r in rows} == set(range(ROWS * COLUMNS))
    assert {r.src for r in rows if r.balance is None} == set(range(ROWS * COLUMNS)) - {k for k in range(1, 27) if k % 4}


def test_unpool_matrix(sparse):
    rows = result(sparse, "unpool_matrix").collect()
    assert {r.dst for r in rows} == set(range(ROWS * COLUMNS)) and "balance" in rows[0]


def test_inversion_error(sparse):
    rows = result(sparse, "inversion_error").collect()
    assert {r.node for r in rows} == set(range(8)) and "balance" in rows[0]


def test_compose(sparse):
    rows = result(sparse, "compose").collect()
    assert {r.src for r in rows} == set(range(ROWS * COLUMNS))
    assert {r.src for r in rows if r.balance is None} == set(range(ROWS * COLUMNS)) - {k for k in range(1, 27) if k % 4}


def test_cotan_laplacian(sparse):
    rows = result(sparse, "cotan_laplacian").collect()
    assert {r.j for r in rows} == set(range(COLUMNS, 3 * COLUMNS)) and "balance" in rows[0]


def test_lumped_mass(sparse):
    rows = result(sparse, "lumped_mass").collect()
    assert {r.i for r in rows} == set(range(COLUMNS, 3 * COLUMNS)) and "balance" in rows[0]


def test_cotan_laplacian_inverse_mass(sparse):
    rows = result(sparse, "cotan_laplacian_inverse_mass").collect()
    assert {r.j for r in rows} == set(range(COLUMNS, 3 * COLUMNS)) and "balance" in rows[0]
