"""Physical plans: no row-wise Python in relational work, few shuffles, reduced reads."""

import re

import pytest

from standlab.plans import all_queries

SF = "/root/testdata/sf0.001"
QUERIES = all_queries()


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["stand_density_plot", "plot_summary", "species_share", "crown_profile",
                                  "top_height", "slope_and_aspect", "anova_oneway", "semivariogram"])
def test_stays_in_the_engine(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text


def test_both_running_sums_share_one_shuffle(spark):
    text = plan(spark, "competition_larger")
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_first_row_per_key_is_reduced_before_the_shuffle(spark):
    text = plan(spark, "keep_first_by_key")
    assert "Partial" in text[text.index("Exchange hashpartitioning"):]


def test_terrain_uses_one_shuffle(spark):
    assert len(re.findall(r"Exchange ", plan(spark, "slope_and_aspect"))) == 1


def test_only_needed_columns_are_read(spark):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(spark, "stand_density_plot")).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "l_partkey", "l_linenumber", "l_quantity", "l_linestatus"}


def test_filter_reaches_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*l_line", plan(spark, "stand_density_plot"))


def test_top_n_is_pruned_in_every_task(spark):
    assert "WindowGroupLimit" in plan(spark, "top_height")


def test_crown_levels_are_not_shuffled(spark):
    text = plan(spark, "crown_profile")
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len(keys) == 2 and all(k.startswith("block") and "spp" not in k and "level" not in k for k in keys)
    # levels are unfolded last, from one line per group
    assert text.index("Generate posexplode") < text.index("HashAggregate") and "Window" not in text


def test_contrasts_read_the_shapes_and_not_the_trees(spark, monkeypatch):
    from standlab.operators import compare
    seen, contrasts = [], compare.model_contrasts
    monkeypatch.setattr(compare, "model_contrasts", lambda df, *a: seen.append(df.inputFiles()) or contrasts(df, *a))
    assert QUERIES["beta_shape_contrasts"](spark, "/root/testdata/sf0.01").count() == 15
    assert seen[0] and not any("lineitem" in f for f in seen[0])
