import pytest
from pyspark.sql import functions as F

from tessella.functions import params as P
from tessella.plans import catalog


@pytest.mark.parametrize(("kernels", "signal"), [(4, False), (10, True)])
def test_batches_are_the_records_of_each_seed(spark, kernels, signal):
    seeds = P.seeds(spark, 3, 40)
    first = P.population(seeds, kernels, signal)
    child = P.mutate(first, signal, before=("radius", "a"))
    for r in child.collect():
        parent = P.draw(r["seed"], kernels, signal)
        assert {n: r[n] for n in parent} == P.mutated(parent, r["seed"])
        assert (r["radius_before"], r["a_before"]) == (parent["radius"], parent["a"])
    assert {r["seed"]: r["w"] for r in first.collect()} == {s: P.draw(s, kernels, signal)["w"] for s in range(3, 43)}


def test_parents_of_different_sizes_are_mutated_one_by_one(spark):
    both = P.population(P.seeds(spark, 0, 3), 2).unionByName(P.population(P.seeds(spark, 3, 3), 5)).coalesce(1)
    for r in P.mutate(both).collect():
        assert r["b"] == P.mutated(P.draw(r["seed"], 2 if r["seed"] < 3 else 5, False), r["seed"])["b"]


def test_a_child_needs_no_join_and_its_numbers_go_to_all_cores(spark):
    """The customers of one file are drawn once and by more than one task."""
    spark.range(30).select(F.col("id").alias("c_custkey")).coalesce(1).write.mode("overwrite").parquet(path := spark.conf.get("spark.sql.warehouse.dir") + "/few/customer.parquet")
    found = catalog.QUERIES["mutate_population"](spark, path.rpartition("/")[0])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan parquet") == 1
    assert found.rdd.getNumPartitions() >= 8 and found.where("in_range and changed and near").count() == 30
    assert catalog.QUERIES["sample_population"](spark, path.rpartition("/")[0]).rdd.getNumPartitions() >= 8
