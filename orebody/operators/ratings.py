"""Collaborative filtering on ratings (u, b, stars) with one row per pair: models, predictions, blends and cold starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.operators import grid
from orebody.operators.similar import hash_family
from orebody.operators.skew import TASK, plan_load, skew_join
from orebody.plans.session import materialise


def at_least(ratings: DataFrame, key: str, n: int) -> DataFrame:
    """Ratings of the keys that have n or more."""
    return ratings.join(ratings.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") >= n).select(key), key, "left_semi")


_SUMS = {"n": F.count, "sx": F.sum, "sy": F.sum, "sxx": F.sum, "syy": F.sum, "sxy": F.sum}


def _correlation(sums: DataFrame, least: int) -> DataFrame:
    over = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    under = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    good = (F.col("n") >= least) & (over != 0) & (under > 0)
    return sums.withColumn("sim", F.when(good, F.round(over / F.sqrt(F.when(under > 0, under).otherwise(1.0)), 6)).otherwise(-1.0))


def _sums(joined: DataFrame, keys: list[str]) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    part = joined.groupBy(*([TASK] if TASK in joined.columns else []), *keys).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")
    )
    return part.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _SUMS))


def pearson_all(ratings: DataFrame, item: str, by: str, least: int = 3, positive: bool = False) -> DataFrame:
    """(i1, i2, sim, n), i1 < i2: Pearson over the raters both items have, for all pairs with `least` or more of them; -1
    where the numerator or a variance is 0. Common ratings are made and summed up cell by cell (grid), never exchanged."""
    rows, items, _ = _rows(ratings.dropna(subset=["stars"]), item, by)
    found = _correlation(grid.pairs(rows, grid.Rule(least, positive=positive)), least).select("i1", "i2", "sim", "n")
    return grid.named(grid.named(found, "i1", items), "i2", items)


def _rows(ratings: DataFrame, item: str, by: str, dense: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Ratings (i, k, x) with numbers for items and raters, stored, and the numbers of either."""
    r = materialise(ratings.select(F.col(item).alias("i"), F.col(by).alias("k"), F.col("stars").alias("x")).dropna(subset=["i", "k"]), "ratings")
    rows, items = grid.numbered(r, "i")
    rows, raters = grid.numbered(rows, "k", dense)
    return rows, items, raters


def pearson_of(pairs: DataFrame, ratings: DataFrame, item: str, by: str, least: int = 3) -> DataFrame:
    """As pearson_all for given pairs (r1, r2)."""
    r = ratings.select(F.col(item).alias("i"), F.col(by).alias("k"), "stars").dropna()
    wanted = materialise(pairs.select(F.col("r1").alias("i1"), F.col("r2").alias("i2")), "wanted")
    one = skew_join(wanted, r.select(F.col("i").alias("i1"), "k", F.col("stars").alias("x")), plan_load(wanted, ["i1"]), ["i2"]).drop(TASK)
    both = one.join(r.select(F.col("i").alias("i2"), "k", F.col("stars").alias("y")), ["i2", "k"])
    return _correlation(_sums(both, ["i1", "i2"]), least).select("i1", "i2", "sim", "n")


def item_model(ratings: DataFrame, least: int = 3) -> DataFrame:
    """(b1, b2, sim) with sim > 0 of items that have `least` or more ratings, three or more of them of the same raters."""
    kept = at_least(ratings, "b", least) if least > 3 else ratings
    return pearson_all(kept, "b", "u", positive=True).where("sim > 0").select(F.col("i1").alias("b1"), F.col("i2").alias("b2"), "sim")


def _lsh_rule(functions: int, p: int, m: int, high: int, jaccard: float = 0.01, seed: int = 42) -> grid.Rule:
    return grid.Rule(3, jaccard, True, tuple(hash_family(functions, high, seed)), p, m)


def lsh_model(ratings: DataFrame, item: str, by: str, least: int, functions: int, p: int, m: int, high: int, jaccard: float = 0.01, seed: int = 42) -> DataFrame:
    """(i1, i2, sim) with sim > 0 among candidates of MinHash banding (one row a band) of enough Jaccard similarity. With one
    row a band most pairs are candidates, so signatures are compared last, of the pairs that pass the rest."""
    stored = materialise(ratings.select(item, by, "stars"), "ratings")
    rows, items, _ = _rows(at_least(stored, item, least), item, by, dense=True)
    found = _correlation(grid.pairs(rows, _lsh_rule(functions, p, m, high, jaccard, seed)), 3).where("sim > 0").select("i1", "i2", "sim")
    return grid.named(grid.named(found, "i1", items), "i2", items)


def averages(ratings: DataFrame, key: str) -> DataFrame:
    """(key, avg) over the ratings."""
    return ratings.where("stars is not null").groupBy(key).agg((F.sum("stars") / F.count("*")).alias("avg"))


def _both_ways(model: DataFrame, a: str, b: str) -> DataFrame:
    return model.select(F.col(a).alias("own"), F.col(b).alias("far"), "sim").unionByName(model.select(F.col(b).alias("own"), F.col(a).alias("far"), "sim"))


def _nearest(df: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("u", "b").orderBy(F.desc("sim"), "far"))
    return df.withColumn("k", rank).where(F.col("k") <= n)


def _near_model(met: DataFrame, model: DataFrame, own: str, n: int) -> DataFrame:
    return _nearest(met.join(_both_ways(model, *model.columns[:2]).withColumnRenamed("own", own), [own, "far"]), n)


def _near_ratings(pairs: DataFrame, ratings: DataFrame, item: str, by: str, rule: grid.Rule, n: int, dense: bool = False) -> DataFrame:
    """Of stored pairs, (u, b, sim, stars, far_avg) of the n most similar items that the pair's rater has rated: without a
    stored model, and without an exchange of all items that the raters of the pairs have rated."""
    rows, items, raters = _rows(ratings, item, by, dense)
    wanted = materialise(grid.number(materialise(grid.number(pairs.select(F.col(item).alias("own"), F.col(by).alias("key")), "own", items), "wanted"), "key", raters), "wanted")
    near = grid.neighbours(wanted, rows, rule, n).select(F.col("own").alias(item), F.col("key").alias(by), "sim", F.col("x").alias("stars"), "far_avg")
    return grid.named(grid.named(materialise(near, "near"), item, items), by, raters)


def predict_by_items(test: DataFrame, train: DataFrame, model: DataFrame | None = None, n: int = 5, default: float = 3.5) -> DataFrame:
    """(u, b, stars) for distinct test pairs whose user has ratings: the mean of the user's ratings of the n most similar
    items, weighted by similarity (equal ones by item); without any, the item's average, else the default. Without a model,
    similarities are those of item_model(train), made for the test pairs only."""
    pairs = materialise(test.select("u", "b").dropna().distinct(), "wanted")
    if model is None:
        near = _near_ratings(pairs, train.dropna(subset=["stars"]), "b", "u", grid.Rule(3, positive=True), n)
    else:
        rated = train.select("u", F.col("b").alias("far"), "stars")
        near = _near_model(skew_join(pairs, rated, plan_load(pairs, ["u"]), ["b"]).drop(TASK), model, "b", n)
    guess = near.groupBy("u", "b").agg(F.sum(F.col("stars") * F.col("sim")).alias("num"), F.sum(F.abs("sim")).alias("den"))
    known = pairs.join(train.select("u").distinct(), "u", "left_semi")
    out = known.join(guess, ["u", "b"], "left").join(averages(train, "b"), "b", "left")
    return out.select("u", "b", F.when(F.coalesce("num", F.lit(0.0)) != 0, F.col("num") / F.col("den")).otherwise(F.coalesce("avg", F.lit(default))).alias("stars"))


def predict_by_users(test: DataFrame, train: DataFrame, model: DataFrame | None = None, n: int = 5, default: float = 3.5, **lsh) -> DataFrame:
    """(u, b, stars) for distinct test pairs whose item has ratings: the user's average plus the similarity-weighted mean
    of how the n most similar raters of the item deviate from theirs; without any, the user's average, else the default.
    Without a model, similarities are those of lsh_model(train, "u", "b", **lsh), made for the test pairs only."""
    pairs = materialise(test.select("u", "b").dropna().distinct(), "wanted")
    mean = averages(train, "u")
    if model is None:
        near = _near_ratings(pairs, at_least(train, "u", lsh.pop("least")), "u", "b", _lsh_rule(**lsh), n, dense=True)
    else:
        raters = train.select(F.col("u").alias("far"), "b", "stars")
        near = _near_model(skew_join(pairs, raters, plan_load(pairs, ["b"]), ["u"]).drop(TASK), model, "u", n)
        near = near.join(mean.select(F.col("u").alias("far"), F.col("avg").alias("far_avg")), "far", "left")
    guess = near.groupBy("u", "b").agg(F.sum((F.col("stars") - F.coalesce("far_avg", F.lit(default))) * F.col("sim")).alias("num"), F.sum(F.abs("sim")).alias("den"))
    known = pairs.join(train.select("b").distinct(), "b", "left_semi")
    own = F.coalesce("avg", F.lit(default))
    out = known.join(guess, ["u", "b"], "left").join(mean, "u", "left")
    return out.select("u", "b", F.when(F.coalesce("num", F.lit(0.0)) != 0, own + F.col("num") / F.col("den")).otherwise(own).alias("stars"))


def blend(predicted: DataFrame, train: DataFrame, default: float = 3.8) -> DataFrame:
    """Predictions blended with averages: base = .7 item + .3 user; .2 of the prediction where base < 1.25, else .1."""
    b, u = averages(train, "b").withColumnRenamed("avg", "ba"), averages(train, "u").withColumnRenamed("avg", "ua")
    base = 0.7 * F.coalesce("ba", F.lit(default)) + 0.3 * F.coalesce("ua", F.lit(default))
    joined = predicted.join(b, "b", "left").join(u, "u", "left").withColumn("base", base)
    stars = F.when(F.col("base") < 1.25, 0.2 * F.col("stars") + 0.8 * F.col("base")).otherwise(0.1 * F.col("stars") + 0.9 * F.col("base"))
    return joined.select("u", "b", stars.alias("stars"))


def cold_start(test: DataFrame, train: DataFrame, default: float = 3.8) -> DataFrame:
    """(u, b, stars) for test pairs whose user or item has no rating: .1 of the item's average and .9 of the default where
    the average is known, else the default."""
    pairs = test.select("u", "b").dropna().distinct()
    users = train.select("u").distinct().withColumn("ku", F.lit(True))
    out = pairs.join(users, "u", "left").join(averages(train, "b"), "b", "left").where("ku is null or avg is null")
    return out.select("u", "b", F.when(F.col("avg").isNotNull(), 0.1 * F.col("avg") + 0.9 * default).otherwise(default).alias("stars"))


def cold_start_with_friends(test: DataFrame, train: DataFrame, friends: DataFrame, default: float = 3.8) -> DataFrame:
    """The intended form of cold_start: user average, item average and the mean of the averages of influential friends
    (u, friend), each where known, in equal parts with the default."""
    pairs = test.select("u", "b").dropna().distinct()
    mean = averages(train, "u")
    circle = friends.join(mean.withColumnRenamed("u", "friend"), "friend").groupBy("u").agg(F.avg("avg").alias("fa"))
    out = pairs.join(mean.withColumnRenamed("avg", "ua"), "u", "left").join(averages(train, "b").withColumnRenamed("avg", "ba"), "b", "left").join(circle, "u", "left").where("ua is null or ba is null")
    known = F.array_compact(F.array("ua", "ba", "fa", F.lit(default)))
    return out.select("u", "b", (F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).alias("stars"))


def influential_friends(users: DataFrame, n: int = 5) -> DataFrame:
    """(user_id, friend, useful, rank): of the users that name a friend, the n with the most `useful` for each friend, as
    (friend, user); equal ones by id. friends is a comma-separated list; None, void places and unknown users are skipped,
    a null useful counts as 0."""
    named = users.where("friends is not null").select("user_id", F.coalesce("useful", F.lit(0)).alias("useful"), F.explode(F.split("friends", ",")).alias("f0"))
    named = named.select("user_id", "useful", F.trim("f0").alias("friend")).where("friend <> '' and friend <> 'None'").distinct()
    rank = F.row_number().over(Window.partitionBy("friend").orderBy(F.desc("useful"), "user_id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= n)
