"""Data-mining operators against brute force and known values, with nulls, ties and empty inputs."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from orebody.functions.codes import code_mod, trailing_zeros, trim_all
from orebody.operators import clustering, content, explore, graph, itemsets, ratings, similar, sketches
from orebody.operators.numbering import dense_index
from orebody.sources import readers, sinks
from orebody.streaming import streams
from pyspark.sql import functions as F


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# exploration


def test_words_and_counts(spark):
    r = spark.createDataFrame([("The, the cat. cat", "2019-01-01", "u"), (None, None, None), ("", "x2019", "u"), ("... the", "2020", "v")], "text string, date string, user_id string")
    stops = spark.createDataFrame([("the ",), ("the",), (None,)], "value string")
    assert [tuple(x) for x in explore.top_words(r, "text", stops, 9).collect()] == [("", 2), ("cat", 2), ("the", 1)]
    assert tuple(explore.review_counts(r, "2019").first()) == (4, 2, 2)
    assert tuple(explore.review_counts(r.limit(0), "2019").first()) == (0, 0, 0)
    assert rows(explore.top_keys(r, "user_id", 1)) == [("u", 2)]


def test_category_average_half_up(spark):
    r = spark.createDataFrame([("a", 1.0), ("a", 1.5), ("b", 4.0), (None, 5.0), ("c", None), ("d", 2.0)], "business_id string, stars double")
    b = spark.createDataFrame([("a", "X, Y"), ("b", "Y,Y"), ("c", "Z"), ("d", None), ("e", "")], "business_id string, categories string")
    want = [("X", 1.3, 2), ("Y", 2.6, 4)]
    assert rows(explore.comma_averages(r, b)) == want and rows(explore.category_averages(r, b)) == want


def test_partitions(spark):
    df = spark.createDataFrame([("a1",), ("a2",), ("b",), (None,), ("",)], "k string")
    report = dict(rows(explore.partition_report(explore.custom_partitioned(df, "k", 5), 5)))
    assert report == {0: 2, 1: 0, 2: 2, 3: 1, 4: 0}
    assert rows(explore.keys_above(spark.createDataFrame([("a",)] * 3 + [("b",)] * 2, "k string"), "k", 2)) == [("a", 3)]


def test_dense_index(spark):
    r = random.Random(3)
    keys = [f"k{r.randint(0, 500)}" for _ in range(2000)] + [None]
    got = dict(rows(dense_index(spark.createDataFrame([(k,) for k in keys], "k string"), "k")))
    assert got == {k: i for i, k in enumerate(sorted(set(keys) - {None}))}
    assert dense_index(spark.createDataFrame([], "k string"), "k").count() == 0


# itemsets


def brute_itemsets(baskets, support):
    out = {}
    items = sorted({x for b in baskets for x in b})
    for k in range(1, len(items) + 1):
        level = {c: sum(set(c) <= b for b in baskets) for c in itertools.combinations(items, k)}
        level = {c: n for c, n in level.items() if n >= support}
        if not level:
            break
        out |= level
    return out


@pytest.mark.parametrize("support", [1, 4, 7, 85])
def test_itemsets(spark, support):
    r = random.Random(support)
    baskets = [{c for c in "abcdef" if r.random() < 0.55} for _ in range(40)] if support < 85 else [{"a", "b"}] * 85
    data = [(i, x) for i, b in enumerate(baskets) for x in b] + [(0, None), (None, "a"), (0, sorted(baskets[0] or {"a"})[0])]
    baskets[0] = baskets[0] or {"a"}
    pairs = itemsets.pairs_of(spark.createDataFrame(data, "b int, i string"), "b", "i")
    want = brute_itemsets(baskets, support)
    for found in (itemsets.apriori(pairs, support), itemsets.son(pairs, support)):
        assert {tuple(x["items"]): x.support for x in found.collect()} == want
    assert {tuple(x["items"]): x.support for x in itemsets.fp_growth(pairs, support).collect()} == want
    assert tuple(itemsets.compare(itemsets.son(pairs, support), itemsets.fp_growth(pairs, support)).first()) == (len(want),) * 3


def test_itemsets_empty_and_filter(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "b int, i string")
    assert rows(itemsets.pairs_of(df, "b", "i", more_than=1)) == [(1, "a"), (1, "b")]
    assert itemsets.apriori(itemsets.pairs_of(df.limit(0), "b", "i"), 1).count() == 0
    lines = sinks.itemset_lines(itemsets.apriori(itemsets.pairs_of(df, "b", "i"), 1)).collect()
    assert [x.value for x in lines] == ["('a'),('b')", "('a', 'b')"]


# similarity


def test_similarity(spark):
    r = random.Random(5)
    sets = {i: {r.randint(0, 30) for _ in range(r.randint(1, 8))} for i in range(40)} | {90: set(range(5)), 91: set(range(5)), 92: {0}}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s] * 2 + [(None, 1), (3, None)], "r int, t int")
    truth = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    want = {p for p, s in truth.items() if s >= 0.2}
    exact = similar.exact_pairs(df, "r", "t", 0.2)
    assert {(x.r1, x.r2) for x in exact.collect()} == want
    sig = similar.signatures(df, "r", "t", similar.hash_family(60, 1000, 1), 997, 997)
    assert sig.count() == len(sets) * 60
    found = similar.jaccard_of(similar.candidates(sig, "r"), df, "r", "t", 0.2)
    q = similar.quality(found, exact).first()
    assert q.precision == 1.0 and q.recall > 0.95 and {(x.r1, x.r2) for x in found.collect()} <= want
    two = similar.candidates(sig, "r", rows_per_band=2)
    assert (90, 91) in {(x.r1, x.r2) for x in two.collect()} and two.count() < similar.candidates(sig, "r").count()
    empty = df.limit(0)
    assert similar.exact_pairs(empty, "r", "t", 0.2).count() == 0 and tuple(similar.quality(exact.limit(0), exact.limit(0)).first()) == (0, 0, 1.0, 1.0)


# content


def test_content(spark):
    r = spark.createDataFrame([("1", "a", "u", "Cats cats dogs the"), ("2", "a", "u", None), ("3", "b", "u", "dogs"), ("4", "c", "v", "the 12"), ("5", None, "v", "cats")], "review_id string, business_id string, user_id string, text string")
    w = content.term_weights(r, spark.createDataFrame([("the ",)], "value string"))
    assert rows(w) == [("a", "cats", round(math.log2(3), 6)), ("a", "dogs", round(0.5 * math.log2(1.5), 6)), ("b", "dogs", round(math.log2(1.5), 6))]
    prof = content.business_profiles(w, 1)
    assert [(x.business_id, x.word) for x in prof.orderBy("business_id").collect()] == [("a", "cats"), ("b", "dogs")]
    up = content.user_profiles(r, prof, 5)
    assert [(x.user_id, x.word) for x in up.orderBy("rank").collect()] == [("u", "cats"), ("u", "dogs")]
    pairs = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "zz"), (None, "a")], "user_id string, business_id string")
    assert rows(content.content_similarity(pairs, up, prof)) == [("u", "a", round(1 / math.sqrt(2), 6))]
    assert rows(content.content_similarity(pairs, up, prof, least=0)) == [("u", "a", round(1 / math.sqrt(2), 6)), ("u", "zz", 1e-5)]
    assert rows(content.model_document(prof, "business_id")) == [("a", ["cats"]), ("b", ["dogs"])]


# ratings


def test_pearson_edges(spark):
    data = [("u1", "a", 1.0), ("u2", "a", 2.0), ("u3", "a", 3.0), ("u1", "b", 2.0), ("u2", "b", 4.0), ("u3", "b", 5.0), ("u1", "c", 3.0), ("u2", "c", 3.0), ("u3", "c", 3.0), ("u1", "d", 1.0), ("u2", "d", 5.0)]
    df = spark.createDataFrame(data, "u string, b string, stars double")
    got = {(x.i1, x.i2): x.sim for x in ratings.pearson_all(df, "b", "u").collect()}
    assert got == {("a", "b"): round(float(np.corrcoef([1, 2, 3], [2, 4, 5])[0, 1]), 6), ("a", "c"): -1.0, ("b", "c"): -1.0}
    assert rows(ratings.item_model(df)) == [("a", "b", got["a", "b"])]


def test_predictions(spark):
    train = spark.createDataFrame([("u", "a", 4.0), ("u", "c", 2.0), ("v", "b", 5.0), ("v", "a", 3.0)], "u string, b string, stars double")
    test = spark.createDataFrame([("u", "b"), ("u", "b"), ("u", "x"), ("w", "a"), ("w", "y"), (None, "a")], "u string, b string")
    model = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.25)], "b1 string, b2 string, sim double")
    assert rows(ratings.predict_by_items(test, train, model)) == [("u", "b", (4 * 0.5 + 2 * 0.25) / 0.75), ("u", "x", 3.5)]
    users = spark.createDataFrame([("u", "v", 0.5)], "i1 string, i2 string, sim double")
    assert rows(ratings.predict_by_users(test, train, users)) == [("u", "b", 3.0 + (5 - 4)), ("w", "a", 3.5)]
    assert rows(ratings.cold_start(test, train)) == [("u", "x", 3.8), ("w", "a", pytest.approx(0.35 + 3.42)), ("w", "y", 3.8)]
    friends = spark.createDataFrame([("w", "v"), ("w", "nobody")], "u string, friend string")
    assert dict(((x.u, x.b), x.stars) for x in ratings.cold_start_with_friends(test, train, friends).collect()) == {("u", "x"): pytest.approx((3 + 3.8) / 2), ("w", "a"): pytest.approx((3.5 + 4 + 3.8) / 3), ("w", "y"): pytest.approx((4 + 3.8) / 2)}
    low = spark.createDataFrame([("u", "a", 1.0)], "u string, b string, stars double")
    assert rows(ratings.blend(spark.createDataFrame([("u", "a", 4.0)], "u string, b string, stars double"), low)) == [("u", "a", pytest.approx(0.8 + 0.8))]


def test_friends(spark):
    u = spark.createDataFrame([("a", 3, "x, y"), ("b", None, "x,x, None"), ("c", 3, "x"), ("d", 9, None), ("e", 1, "")], "user_id string, useful bigint, friends string")
    got = ratings.influential_friends(u, 2)
    assert sorted((x.friend, x["rank"], x.user_id) for x in got.collect()) == [("x", 1, "a"), ("x", 2, "c"), ("y", 1, "a")]


# graphs

EDGES = [(1, 2), (1, 3), (2, 3), (2, 4), (4, 5), (4, 6), (4, 7), (5, 6), (6, 7)]


def brute_betweenness(edges):
    adjacent = {}
    for a, b in edges:
        adjacent.setdefault(a, set()).add(b)
        adjacent.setdefault(b, set()).add(a)
    total = Counter({tuple(sorted(e)): 0.0 for e in edges})
    for s, t in itertools.combinations(sorted(adjacent), 2):
        paths, best = [[s]], None
        while paths and best is None:
            best = [p for p in paths if p[-1] == t] or None
            if best is None:
                paths = [[*p, w] for p in paths for w in adjacent[p[-1]] if w not in p]
        for p in best or []:
            for e in zip(p, p[1:]):
                total[tuple(sorted(e))] += 1 / len(best)
    return total


def test_graph(spark):
    pairs = spark.createDataFrame([*EDGES, (10, 11), (5, 5)], "a int, b int")
    edges = graph.both_directions(pairs, "a", "b")
    want = brute_betweenness([*EDGES, (10, 11)])
    got = {(x.v1, x.v2): x.betweenness for x in graph.betweenness(edges).collect()}
    assert got == {e: pytest.approx(v, abs=1e-5) for e, v in want.items()} and got[2, 4] == 12.0
    assert dict(rows(graph.components(edges))) == {**dict.fromkeys(range(1, 8), 1), 10: 10, 11: 10}
    parts = graph.girvan_newman(edges).collect()
    assert {x.id: x.community for x in parts} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 10: 10, 11: 10}
    q = graph.modularity(edges, spark.createDataFrame([(x.id, x.community) for x in parts], "id int, label int")).first()[0]
    assert q == pytest.approx(parts[0].modularity) and -1 <= q <= 1
    labels = dict(rows(graph.label_propagation(edges, 0)))
    assert labels == {v: v for v in [*range(1, 8), 10, 11]}
    sizes = graph.communities(spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id int, label int")).collect()
    assert [tuple(x) for x in sizes] == [(1, "3"), (2, "1, 2")]


def test_girvan_newman_of_large_components(spark, monkeypatch):
    """A component beyond the bound is cut by spread searches, with the same result."""
    edges = graph.both_directions(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (10, 11), (11, 12)], "a int, b int"), "a", "b")
    whole = rows(graph.girvan_newman(edges))
    monkeypatch.setattr(graph, "MOST_VERTICES", 3)
    assert rows(graph.girvan_newman(edges)) == whole


def test_long_path_and_empty_graph(spark):
    path = graph.both_directions(spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int"), "a", "b")
    assert {x.component for x in graph.components(path).collect()} == {0}
    none = path.limit(0)
    assert graph.components(none).count() == graph.betweenness(none).count() == graph.girvan_newman(none).count() == graph.label_propagation(none).count() == 0


# sketches


def test_codes(spark):
    text = ["Las Vegas", "", "é", "x" * 300, None]
    got = spark.createDataFrame([(t,) for t in text], "t string").select(code_mod(F.col("t"), 22777).alias("c"), trim_all(F.col("t"))).collect()
    want = [int.from_bytes(t.encode(), "big") % 22777 if t is not None else None for t in text]
    assert [r.c for r in got] == want and want[0] == 2773
    zeros = spark.createDataFrame([(1,), (8,), (12,), (0,)], "v bigint").select(trailing_zeros(F.col("v")).alias("z")).collect()
    assert [r.z for r in zeros] == [0, 3, 2, None]


def test_bloom_has_no_false_negatives(spark):
    df = spark.createDataFrame([(f"city{i}",) for i in range(200)] + [(None,), ("",)], "city string")
    bits = sketches.bloom_bits(df.where("city < 'city2' or city is null"), "city")
    got = {r.city: r.pred for r in sketches.bloom_probe(df, "city", bits).collect()}
    assert all(got[f"city{i}"] == 1 for i in range(200) if f"city{i}" < "city2") and got[None] == got[""] == 0
    assert sum(got.values()) < 160
    assert {r.pred for r in sketches.bloom_probe(df, "city", bits.limit(0)).collect()} == {0}


def test_flajolet_martin(spark):
    df = spark.createDataFrame([(f"v{i % 60}",) for i in range(300)] + [(None,), ("",)], "v string")
    got = sketches.fm_estimates(sketches.fm_maxima(df, "v")).first()
    want = []
    for a, b in sketches.FM_FAMILY:
        hs = [(a * int.from_bytes(f"v{i}".encode(), "big") + b) % sketches.FM_P for i in range(60)]
        want.append(max((len(bin(h)) - len(bin(h).rstrip("0")) for h in hs if h), default=0))
    assert [got[f"r{i}"] for i in range(10)] == want and got.truth == 60
    assert got.estimate == sketches.combine_estimates([2.0**r for r in want])
    assert sketches.combine_estimates([4, 8, 8, 4000.0]) == 6


def test_ranks_and_reservoir(spark):
    df = spark.createDataFrame([(t,) for t in "aaabbbccdef"] + [(None,)], "t string")
    assert [r.value for r in sinks.rank_lines(sketches.ranked_values(df, "t", 2), "t").collect()] == ["a, b : 3", "c : 2"]
    assert rows(sketches.ranked_values(df, "t", 2)) == [("a", 3, 1), ("b", 3, 1), ("c", 2, 2)]
    ids = spark.range(1000)
    one, two = (sorted(r.id for r in sketches.reservoir(x, "id", 50).collect()) for x in (ids, ids.repartition(7)))
    assert one == two and len(set(one)) == 50


def test_streams(spark, tmp_path):
    base = spark.createDataFrame([(i, f"2020-01-01 0{i % 6}:10:00", f"tag{i % 4}", f"hello #a{i % 3} #b") for i in range(60)] + [(99, None, None, None)], "id int, t string, v string, text string").withColumn("ts", F.col("t").cast("timestamp"))
    base.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), base, "ts")
    got = streams.run_available(streams.windowed_maxima(stream, "ts", "v")).drop("batch")
    want = sketches.fm_maxima(sketches.sliding(base.where("ts is not null"), "ts"), "v", ["start"])
    assert rows(got.select(sorted(got.columns))) == rows(want.select(sorted(want.columns)))
    tags = streams.run_available(streams.tags_of(streams.tracked(stream, "text", ["HELLO"]), "text").select(F.explode("tags").alias("tag")), "append")
    assert tags.where("tag = 'b'").count() == 60 and tags.count() == 120
    for compatible in (False, True):
        out = streams.run_available(streams.reservoir_stream(stream, "v", 20, bug_compatible=compatible), "update").orderBy(F.desc("count")).first()
        assert out["count"] == 60 and len(out["sample"]) == 20


# clusters


def blobs(spark, n=120, d=4, k=3, seed=1):
    r = np.random.default_rng(seed)
    centres = np.arange(k)[:, None] * 50.0 + r.normal(size=(k, d))
    return spark.createDataFrame([(i, [float(x) for x in centres[i % k] + r.normal(size=d)]) for i in range(n)], "id int, vec array<double>")


def test_kmeans_and_outliers(spark):
    points = blobs(spark)
    assigned, stats = clustering.kmeans(points, 3, 20)
    got = {r.id: r.c for r in assigned.collect()}
    assert len(got) == 120 and sum(s.n for s in stats.values()) == 120
    far = points.unionByName(spark.createDataFrame([(999, [9e4] * 4)], "id int, vec array<double>"))
    assigned, stats = clustering.kmeans(far, 3, 20, far=500.0, seed=3)
    assert sum(s.n for s in stats.values()) + assigned.where("c < 0").count() == 121
    empty, none = clustering.kmeans(points.limit(0), 3, 5)
    assert empty.count() == 0 and none == {}


def test_bfr_conserves_points(spark):
    points = blobs(spark, 150)
    report, assignment = clustering.bfr([points.where(F.col("id") % 3 == i) for i in range(3)], 3)
    assert [r[2] + r[4] + r[5] for r in report] == [50, 100, 150]
    got = {r.point_id: r.cluster for r in assignment.collect()}
    assert len(got) == 150 and set(got.values()) <= {-1, 0, 1, 2}


def test_bfr_without_points(spark):
    none = blobs(spark).limit(0)
    report, assignment = clustering.bfr([none, none], 3)
    assert [r[1:] for r in report] == [(0, 0, 0, 0, 0)] * 2 and assignment.count() == 0


def test_one_point():
    s = clustering.Summary(2, np.array([1.0, 3.0]), np.array([2.0, 10.0])).with_point(np.array([4.0, 0.0]))
    assert s.n == 3 and s.mean.tolist() == [2.0, 2.0] and s.squares.tolist() == [pytest.approx(20 / 3), pytest.approx(20 / 3)]


def test_sharded_reservoir(spark, tmp_path):
    """The merged shards of a stream in many batches are the sample of the whole table."""
    df = spark.range(900).select("id", F.concat(F.lit("v"), F.col("id") % 50).alias("v"))
    df.repartition(7).write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), df)
    kept = streams.run_available(streams.sharded_reservoir(stream, "id", "v", size=20), "update")
    assert rows(streams.merge_reservoir(kept, 20).select(F.col("k").cast("long"), "v")) == rows(sketches.reservoir(df, "id", 20))
    assert kept.groupBy("shard").agg(F.max("count").alias("n")).agg(F.sum("n")).first()[0] == 900


def test_socket_lines(spark):
    import socket
    import threading
    import time

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        peer, _ = server.accept()
        peer.sendall(b"a #one\nb\nc #two\n")
        time.sleep(8)
        peer.close()

    threading.Thread(target=serve, daemon=True).start()
    lines = streams.tags_of(streams.socket_lines(spark, "127.0.0.1", server.getsockname()[1]), "value").select(F.explode("tags").alias("tag"))
    query = lines.writeStream.format("memory").queryName("socket_tags").outputMode("append").start()
    for _ in range(60):
        time.sleep(0.2)
        if spark.table("socket_tags").count() == 2:
            break
    query.stop()
    assert rows(spark.table("socket_tags")) == [("one",), ("two",)]


def test_merge_of_compressed():
    s = lambda m: clustering.Summary(2, np.array([m]), np.array([m * m + 1.0]))
    out, went = clustering.merge_compressed({1: s(0.0), 2: s(1.0), 3: s(1.5), 4: s(99.0)}, 3.0)
    assert went == {3: 2} and set(out) == {1, 2, 4} and out[2].n == 4
    assert clustering.Summary(3, np.array([2.0]), np.array([4.0])).std.tolist() == [clustering.FLOOR_STD]


# sources and sinks


def test_round_trips(spark, tmp_path):
    p = lambda x: str(tmp_path / x)
    points = "0,1.5,2\n1,3,4\n"
    (tmp_path / "pts").mkdir()
    (tmp_path / "pts/b.csv").write_text(points)
    (tmp_path / "pts/a.csv").write_text("7,1,1\n")
    assert rows(readers.csv_points(spark, p("pts"))) == [(0, 7, [1.0, 1.0]), (1, 0, [1.5, 2.0]), (1, 1, [3.0, 4.0])]
    (tmp_path / "w.txt").write_text("the \n a\n")
    assert rows(readers.word_list(spark, p("w.txt"))) == [("a",), ("the",)]
    model = {"business": spark.createDataFrame([("b", ["x", "y"])], "business_id string, feature_vector array<string>"), "user": spark.createDataFrame([("u", ["x"])], "user_id string, feature_vector array<string>")}
    sinks.json_report(model, p("model"))
    users, businesses = readers.content_model(spark, p("model"))
    assert rows(users) == [("u", "x")] and rows(businesses) == [("b", "x"), ("b", "y")]
    sims = spark.createDataFrame([("a", "b", 0.5)], "b1 string, b2 string, sim double")
    sinks.json_rows(sims, p("sims"))
    assert rows(readers.similarity_model(spark, p("sims"))) == [("a", "b", 0.5)]
    sinks.json_map(spark.createDataFrame([("a", 1.5), ("b", 2.0)], "k string, v double"), "k", "v", p("map"))
    assert rows(readers.average_map(spark, p("map"), "k")) == [("a", 1.5), ("b", 2.0)]
    (tmp_path / "bad.json").write_text('{"b1": "a", "sim": 1}\nnot json\n')
    assert readers.similarity_model(spark, p("bad.json")).count() == 2
    (tmp_path / "sets.txt").write_text("b, a\n\nc\n")
    assert rows(readers.itemset_text(spark, p("sets.txt"))) == [(["a", "b"],), (["c"],)]
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0)], "v1 string, v2 string, betweenness double")
    sinks.text_lines(sinks.edge_lines(edges), p("edges"))
    assert [r.value for r in sinks.edge_lines(edges).collect()] == ["('a', 'c'), 2.0", "('a', 'b'), 1.0"]
    labels = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "id string, label int")
    assert [r.value for r in sinks.community_lines(labels).collect()] == ["'c'", "'a', 'b'"]
    assert sinks.prediction_line(spark.createDataFrame([(2, 0), (1, 1)], "row int, pred int")).first().value == "1 0"
    sinks.csv_rows(sims.select("b1", "b2"), p("pairs"))
    assert rows(readers.csv_pairs(spark, p("pairs"), "b1 string, b2 string")) == [("a", "b")]
