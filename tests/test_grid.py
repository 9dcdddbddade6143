"""Pairs and neighbours counted in a grid of cells: against brute force, and without writing or exchanging meetings."""

import itertools
import random

import pytest

from orebody.operators import grid, ratings
from orebody.operators.similar import hash_family
from orebody.plans.session import materialise

LSH = {"functions": 5, "p": 2_147_483_647, "m": 2_147_483_647, "high": 2_147_483_646}


def moved(spark, what):
    """Rows written to the shared folder and rows exchanged while what() runs."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    first = {s.stageId() for s in _stages(spark, store)}
    what()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    new = [s for s in _stages(spark, store) if s.stageId() not in first]
    return sum(s.outputRecords() for s in new), sum(s.shuffleWriteRecords() for s in new)


def _stages(spark, store):
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    found = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return [found.apply(i) for i in range(found.size())]


def hot(spark, n=900):
    """n users who rated the same six items, nearly all alike, and one item of their own each."""
    r = random.Random(3)
    rows = [(f"u{u:04d}", f"b{b}", float(min(5, max(1, b - (r.random() < 0.3))))) for u in range(n) for b in range(6)]
    return spark.createDataFrame(rows + [(f"u{u:04d}", f"own{u:04d}", 3.0) for u in range(n)], "u string, b string, stars double")


def test_lsh_model_writes_and_exchanges_no_pairs_but_its_own(spark):
    """project_item_model and user_model: 404,550 pairs meet in six items each, and nearly all are candidates."""
    df = materialise(hot(spark), "hot")
    seen = []
    written, exchanged = moved(spark, lambda: seen.append(ratings.lsh_model(df, "u", "b", 8, **LSH).count()))
    assert seen == [0] and written < 20 * 6300 and exchanged < 20 * 6300
    written, exchanged = moved(spark, lambda: seen.append(materialise(ratings.lsh_model(df.where("stars is not null"), "u", "b", 3, jaccard=0.9, **LSH), "model").count()))
    assert seen[1] == 0 and written < 20 * 6300 and exchanged < 20 * 6300


def table(seed, records=40, members=25):
    r = random.Random(seed)
    return {(i, k): r.choice([1.0, 2.0, 3.0, 4.0, 5.0, None]) for i in range(records) for k in range(members) if r.random() < (0.9 if k < 3 else 0.25)}


def brute(rows, rule):
    by = {}
    for (i, k), x in rows.items():
        by.setdefault(i, {})[k] = x
    sig = {i: [min((a * k + b) % rule.p % rule.m for k in v) for a, b in rule.family] for i, v in by.items()}
    out = {}
    for i, j in itertools.combinations(sorted(by), 2):
        common = set(by[i]) & set(by[j])
        xy = [(by[i][k], by[j][k]) for k in common if by[i][k] is not None and by[j][k] is not None]
        if len(xy) < rule.least or not common or len(common) / len(set(by[i]) | set(by[j])) < rule.jaccard:
            continue
        if rule.family and not any(a == b for a, b in zip(sig[i], sig[j])):
            continue
        n, sx, sy = len(xy), sum(x for x, _ in xy), sum(y for _, y in xy)
        sxx, syy, sxy = sum(x * x for x, _ in xy), sum(y * y for _, y in xy), sum(x * y for x, y in xy)
        under = (sxx - sx * sx / max(1, n)) * (syy - sy * sy / max(1, n))
        if rule.positive and not (sxy - sx * sy / n > 0 and under > 0):
            continue
        out[i, j] = (len(common), len(by[i]), len(by[j]), n, sx, sy, sxx, syy, sxy)
    return out


@pytest.mark.parametrize("rule", [grid.Rule(), grid.Rule(3, positive=True), grid.Rule(0, jaccard=0.3), grid.Rule(3, 0.2, True, tuple(hash_family(2, 1000, 5)), 997, 50)])
@pytest.mark.parametrize("counters, hot", [(1 << 23, 0), (1, 0), (100, 4), (1 << 23, 64)])
def test_cells_against_brute_force(spark, monkeypatch, rule, counters, hot):
    """In blocks of few meetings, with one counter for each pair, with hashed ones, and with products of matrices."""
    monkeypatch.setattr(grid, "HOT", hot)
    monkeypatch.setattr(grid, "PIECE", 7)
    monkeypatch.setattr(grid, "MEETINGS", 60)
    monkeypatch.setattr(grid, "COUNTERS", counters)
    monkeypatch.setattr(grid, "SENT", 20)
    rows = table(1)
    path = grid._stored(spark.createDataFrame([(i, k, x) for (i, k), x in rows.items()], "i bigint, k bigint, x double"), "i", 3, "grid")
    got = {}
    for a, b in itertools.combinations_with_replacement(range(3), 2):
        for f in grid._cell(path, a, b, rule):
            for r in f.drop(columns="agree").itertuples(index=False):
                assert (r[0], r[1]) not in got
                got[r[0], r[1]] = tuple(r[2:])
    want = brute(rows, rule)
    assert got == want and len(want) > 10


def rated(seed, users=60, items=30):
    r = random.Random(seed)
    rows = [(f"u{u:02d}", f"b{b:02d}", float(r.randint(1, 5))) for u in range(users) for b in range(items) if r.random() < (0.6 if b < 4 else 0.12)]
    test = [(f"u{r.randint(0, users + 3):02d}", f"b{r.randint(0, items + 2):02d}") for _ in range(300)] + [("u01", None), (None, "b01")]
    return rows, test


def same(one, two):
    a, b = ({(x.u, x.b): x.stars for x in df.collect()} for df in (one, two))
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_user_predictions_need_no_model(spark, monkeypatch):
    """user_cf_predict: as with the stored model; of users alike, only the few best raters of each pair are written."""
    monkeypatch.setattr(grid, "WORTH", 100)
    train, test = rated(4)
    train, test = (materialise(spark.createDataFrame(x, s), "given") for x, s in ((train, "u string, b string, stars double"), (test, "u string, b string")))
    model = materialise(ratings.lsh_model(train, "u", "b", 3, **LSH), "model")
    assert model.count() > 50
    assert same(ratings.predict_by_users(test, train, least=3, **LSH), ratings.predict_by_users(test, train, model))
    df = materialise(hot(spark), "hot")
    pairs = materialise(df.select("u", "b"), "pairs")
    written, exchanged = moved(spark, lambda: ratings.predict_by_users(pairs, df, least=3, **LSH).count())
    assert written < 30 * 6300 and exchanged < 60 * 6300


def test_quality_is_of_all_pairs_and_none_are_exchanged(spark, monkeypatch):
    """lsh_quality and lsh_similar: as with candidates made first; of users alike below the threshold, nothing is written."""
    from orebody.operators import similar

    monkeypatch.setattr(grid, "WORTH", 100)
    train = materialise(spark.createDataFrame(rated(5)[0], "u string, b string, stars double"), "given")
    family = hash_family(2, 996, 7)
    near = similar.jaccard_of(similar.candidates(similar.signatures(train, "u", "b", family, 997, 997), "u"), train, "u", "b", 0.3)
    marked = materialise(similar.marked_pairs(train, "u", "b", family, 997, 997, 0.3), "marked")
    truth = similar.jaccard_of(marked, train, "u", "b", 0.3)
    want, got = sorted(map(tuple, near.collect())), sorted(map(tuple, similar.lsh_pairs(train, "u", "b", family, 997, 997, 0.3).collect()))
    assert got == want and 10 < len(want) < marked.count() == truth.count()
    assert tuple(similar.quality(marked.where("agree"), marked).first()) == tuple(similar.quality(near, similar.exact_pairs(train, "u", "b", 0.3)).first())
    df = materialise(hot(spark), "hot")
    written, exchanged = moved(spark, lambda: similar.lsh_pairs(df, "u", "b", family, 997, 997, 0.9).count())
    assert written < 20 * 6300 and exchanged < 20 * 6300


def test_lsh_model_reads_its_source_once(spark):
    """user_model: counting the ratings of each user does not make the ratings again."""
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    df = materialise(hot(spark), "hot")
    ratings.lsh_model(df.mapInPandas(count, df.schema), "u", "b", 3, **LSH).count()
    assert seen.value == 6300


def test_item_predictions_need_no_model(spark, monkeypatch):
    """item_cf_predict and hybrid_predict: as with the stored model; of items alike, only the best of each pair are written."""
    monkeypatch.setattr(grid, "WORTH", 100)
    train, test = rated(6)
    train, test = (materialise(spark.createDataFrame(x, s), "given") for x, s in ((train, "u string, b string, stars double"), (test, "u string, b string")))
    model = materialise(ratings.item_model(train), "model")
    assert model.count() > 50
    one, two = ratings.predict_by_items(test, train), ratings.predict_by_items(test, train, model)
    assert same(one, two) and same(ratings.blend(one, train), ratings.blend(two, train))
    df = materialise(hot(spark).toDF("b", "u", "stars"), "hot")
    pairs = materialise(df.select("u", "b"), "pairs")
    written, exchanged = moved(spark, lambda: ratings.predict_by_items(pairs, df).count())
    assert written < 30 * 6300 and exchanged < 60 * 6300
