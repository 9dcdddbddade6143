"""The item model of the project is made of all ratings."""

from orebody.operators import ratings
from orebody.plans.catalogue import QUERIES
from orebody.plans.mining_queries import PRIME
from orebody.sources.tables import order_ratings

FOLDER = "/root/testdata/sf0.001"


def test_project_item_model_takes_all_ratings(spark):
    want = ratings.lsh_model(order_ratings(spark, FOLDER), "b", "u", 5, 60, PRIME, PRIME, PRIME - 1)
    part = ratings.lsh_model(order_ratings(spark, FOLDER, False), "b", "u", 5, 60, PRIME, PRIME, PRIME - 1)
    got, want, part = (sorted(map(tuple, x.collect())) for x in (QUERIES["project_item_model"](spark, FOLDER), want, part))
    print("rows", len(part), len(got))
    assert got == want != part
