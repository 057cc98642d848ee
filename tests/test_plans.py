"""No query over meshes sends their vertices, faces or what is made of them through the driver."""

import pytest

from shapelake import catalog

from .test_queries import SF

#: Queries whose whole work is in the plan they return.
MESH = "mesh_areas mesh_lengths length_ratios open_angle subdivide_midpoint chord_lengths chord_distribution segment_by_distance vertex_groups spine_split border_loops mesh_arrays interior_centres subdivide_by_area sql_meshes".split()


@pytest.mark.parametrize("name", MESH)
def test_meshes_are_not_broadcast(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


@pytest.mark.parametrize("name", ["expand", "shrink", "spine_split", "hull_ratio"])
def test_written_meshes_are_not_broadcast(spark, name, monkeypatch):
    from shapelake.operators import graph, hull

    plans = []
    for module in (graph, hull):
        write = module.materialize

        def kept(df, *a, write=write, **k):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return write(df, *a, **k)

        monkeypatch.setattr(module, "materialize", kept)
    out = catalog.queries()[name](spark, SF)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "BroadcastExchange" in p]
