"""The graph of users that share businesses is not empty at any size, and what is made of it is whole."""

import pytest
import verify
from orebody.plans.catalogue import QUERIES

SHARED_PAIRS = """WITH m AS (SELECT DISTINCT user_id AS r, business_id AS t FROM train_review WHERE user_id IS NOT NULL AND business_id IS NOT NULL)
    SELECT a.r, b.r FROM m a JOIN m b ON a.t = b.t AND a.r < b.r GROUP BY ALL HAVING count(*) >= 7"""


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_review_graph_is_whole(spark, size):
    folder = f"/root/testdata/{size}"
    want = sorted(verify.connect(folder).execute(SHARED_PAIRS).fetchall())
    assert want
    assert sorted((r.v1, r.v2) for r in QUERIES["betweenness"](spark, folder).collect()) == want
    assert {r.id for r in QUERIES["girvan_newman"](spark, folder).collect()} == {v for pair in want for v in pair}
    both = sorted((r.src, r.dst) for r in QUERIES["review_graph"](spark, folder).collect())
    assert both == sorted([*want, *((b, a) for a, b in want)])
