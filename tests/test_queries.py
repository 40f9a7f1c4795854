"""Every query of the core against its SQL on the smallest tables."""

import pytest

from weftline.plans import catalog, oracles


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(name, spark, data, duck, same):
    same(catalog.QUERIES[name](spark, data).toPandas(), duck(oracles.ORACLES[name], data))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracles.ORACLES) - {"tsne_layout", "joint_layouts", "gfd_sampled"}))
def test_query_without_sql_gives_rows(name, spark, data):
    assert catalog.QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", ["tsne_layout", "joint_layouts", "gfd_sampled"])
def test_whole_layouts_and_walks(name, spark, data, monkeypatch):
    """As registered: the operators' own steps, over both frames."""
    from weftline.operators import descent, graphlets

    steps = []
    descend, walk = descent.tsne, graphlets.sampled_counts
    monkeypatch.setattr(descent, "tsne", lambda f, s, p, n=descent.PLAIN_STEPS: steps.append(n == descent.PLAIN_STEPS) or descend(f, s, p, 2))
    joint = descent.joint_layout
    monkeypatch.setattr(descent, "joint_layout", lambda *a: steps.append(a[6:] in ((), (descent.JOINT_STEPS,))) or joint(*a[:6], 2))
    monkeypatch.setattr(graphlets, "sampled_counts", lambda e, steps_=1000, seed=0, **k: steps.append(steps_ == 1000 and not k) or walk(e, 2, seed))
    frames = {r["frame_id"] for r in catalog.QUERIES[name](spark, data).select("frame_id").distinct().collect()}
    assert steps and all(steps) and frames == {0, 1}


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
