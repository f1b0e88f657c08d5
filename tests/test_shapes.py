"""Shape ensemble: its numbers against SQL, and one sort of the points as all that a task holds."""

import random
import re

import duckdb

from terravox.plans import shape_plans, voxel_plans


def items(spark, folder, rows):
    schema = "l_partkey long, l_linenumber int, l_orderkey long, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / "lineitem.parquet"))
    return str(folder)


def test_ensemble_equals_sql(spark, tmp_path):
    """Segments over several batches of rows, on small lattices, without extent, of two points, with points that lack a coordinate."""
    r = random.Random(5)
    rows = [(1, i % 7, i, r.uniform(0, 50), r.uniform(0, 9e4), r.uniform(0, 0.1)) for i in range(2 * shape_plans.ROWS + 300)]
    rows += [(s, i % 7, r.randrange(9), float(r.randrange(5)), 1999.7 * r.randrange(3), 0.01 * r.randrange(3)) for s in range(2, 300) for i in range(r.randrange(1, 14))]
    rows += [(400, 1, i, 2.0, 3.0, 0.04) for i in range(9)]
    rows += [(401, 1, i, *(None if (i + k) % 5 == 0 else r.uniform(0, 1) for k in range(3))) for i in range(40)]
    rows += [(402, 1, i, None, 1.0 * i, 0.1) for i in range(8)]
    found = shape_plans.shape_ensemble(spark, items(spark, tmp_path, rows))
    got = {tuple(row)[:3]: tuple(row)[3:] for row in found.collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = {row[:3]: row[3:] for row in db.execute(shape_plans.PACK["shape_ensemble"][1]).fetchall()}
    assert got == want and len({k[0] for k in got}) > 200


def test_values_on_the_limit_are_rounded():
    values = shape_plans.np.array([2.9999995, 2.99999949, 2.9999994999999996, 0.4999995, 3.0])
    assert shape_plans._floored(values).tolist() == [3, 2, 2, 0, 3]
    assert shape_plans._floored(values, 64).tolist() == [192, 191, 191, 32, 192]


def test_points_are_dealt_and_sorted_once(spark, tmp_path):
    rows = [(s, i, i, 1.0 * i, 2.0 * i, 0.01 * i) for s in range(3) for i in range(5)]
    found = shape_plans.shape_ensemble(spark, items(spark, tmp_path, rows))
    found.collect()
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" not in plan and "Join" not in plan
    whole = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert whole.count("Exchange hashpartitioning") == 1 and whole.count("Sort [") == 1


def test_occupancy_equals_sql_and_holds_no_cells(spark, tmp_path):
    """Segments that fill the grid, reach beyond it, lack coordinates or have all points in one cell; no aggregate by cells."""
    r = random.Random(6)
    rows = [(1, i % 7, i, r.uniform(0, 90), 1999.7 * r.uniform(0, 90), r.uniform(0, 0.2)) for i in range(9000)]
    rows += [(s, 1, i, r.uniform(0, 3), 1999.7 * r.uniform(0, 3), 0.01 * r.randrange(3)) for s in range(2, 60) for i in range(r.randrange(1, 9))]
    rows += [(70, 1, i, 2.0, 3.0, 0.04) for i in range(5)] + [(71, 1, i, *((None, 1.0, 0.1) if i % 3 else (2.0, None, 0.1))) for i in range(6)]
    rows += [(72, 1, i, 1.0 * i if i % 2 else None, 5.0, 0.1) for i in range(9)] + [(None, 1, 1, 1.0, 1.0, 0.1)]
    found = voxel_plans.voxel_occupancy(spark, items(spark, tmp_path, rows))
    got = sorted(map(tuple, found.collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        assert got == sorted(db.execute(voxel_plans.VOXEL_OCCUPANCY).fetchall())
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "bitmap_construct_agg" in plan and not re.search(r"keys=\[[^]]*\bix#", plan)
