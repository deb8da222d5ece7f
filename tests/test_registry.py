"""Every registered query agrees with its SQL on the smallest tables."""

import pytest

from quillrank.plans import registry


def rows(df):
    def cell(v):
        if v is None or v != v:
            return "NULL"
        if isinstance(v, float):
            return f"{v:.6f}".replace("-0.000000", "0.000000")
        return str(v)

    cols = sorted(df.columns)
    return cols, sorted(tuple(map(cell, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["rec_funksvd", "rec_bpr", "rec_asysvd"])
def test_sgd_lists(spark, sf, duck, name):
    """Every user of the events gets the ten best of the unseen items, by score and then item."""
    got = registry.QUERIES[name](spark, sf).toPandas().sort_values(["user_id", "rank"])
    seen = duck.sql(f"WITH {registry.UE} SELECT user_id, item_id FROM ue").df()
    many = seen["item_id"].max() + 1 - seen.groupby("user_id")["item_id"].nunique()
    assert got.groupby("user_id").size().to_dict() == many.clip(upper=10)[lambda x: x > 0].to_dict()
    assert not len(got.merge(seen, on=["user_id", "item_id"]))
    assert list(got["rank"]) == list(got.groupby("user_id").cumcount() + 1)
    assert got.equals(got.sort_values(["user_id", "score", "item_id"], ascending=[True, False, True]))


def test_diversity_needs_listed_items_only(spark, sf, monkeypatch):
    similarity, asked = registry.similarity.similarity, []
    monkeypatch.setattr(registry.similarity, "similarity", lambda m, *a, **how: asked.append(m) or similarity(m, *a, **how))
    assert registry.eval_similarity_diversity(spark, sf).count() == 1
    listed = registry._toppop_lists(spark, sf)[0].filter("rank <= 5").select("item_id").distinct()
    assert asked[0].select("col").distinct().count() == listed.count() < registry.tables.items(spark, sf).count()


def test_split_makes_the_matrix_once(spark, sf):
    split = registry.splits.timestamp(registry.tables.urm_orders(spark, sf))
    assert split._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 2
