"""Operators for training data against brute force and held-out accuracy, with nulls, ties, repeats and empty inputs."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import unseen
from orebody.llm import leaks, mixture, ngrams, pii, pii_table, setjoin, terms, topn
from orebody.llm.pii_table import KINDS, labelled_rows
from pyspark.sql import functions as F


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# distinctive terms


def g2(a, n1, t, n):
    cells = [(a, n1, t), (n1 - a, n1, n - t), (t - a, n - n1, t), (n - n1 - t + a, n - n1, n - t)]
    v = 2 * sum(o * math.log(o * n / (r * c)) for o, r, c in cells if o > 0)
    return max(v, 0) if a * n >= n1 * t else -max(v, 0)


def test_terms(spark):
    r = random.Random(2)
    words = ["ant", "bee", "cat", "dog", "eel", "the"]
    docs = [("hot" if i % 3 == 0 else f"b{r.randint(0, 9)}", f"r{i}", " ".join(r.choices(words, k=r.randint(0, 9)))) for i in range(400)]
    docs += [(None, "x", "cat"), ("b1", "y", None), ("b1", "z", ""), ("c", "w", "THE,the 12 é")] + docs[:50]
    df = spark.createDataFrame(docs, "t string, p string, r string").withColumnRenamed("t", "business").withColumn("c", F.lit("clash"))
    stops = spark.createDataFrame([("the ",), ("the",), (None,)], "value string")
    got = {(x.business, x.term): x for x in terms.distinctive_terms(df, "business", "p", "r", stops, tasks=6).collect()}
    seen, count = set(), {}
    for b, p, t in docs:
        if b is not None and t is not None and (b, p) not in seen:
            seen.add((b, p))
            count.setdefault(b, Counter()).update(w for w in "".join(ch if "a" <= ch <= "z" else " " for ch in t.lower()).split() if w != "the")
    every = sum(count.values(), Counter())
    assert set(got) == {(b, w) for b, c in count.items() for w in c}
    for (b, w), x in got.items():
        assert (x.c, x.m, x.n_record, x.d, x.n_term, x.n_total) == (count[b][w], max(count[b].values()), sum(count[b].values()), sum(w in c for c in count.values()), every[w], sum(every.values()))
        assert x.llr == pytest.approx(g2(x.c, x.n_record, x.n_term, x.n_total), abs=1e-6)
    assert terms.distinctive_terms(df.limit(0), "business", "p", "r", stops, tasks=2).count() == 0


# top items


def test_top_items(spark):
    r = random.Random(4)
    data = [("hot" if i % 3 == 0 else f"g{r.randint(0, 60)}", f"i{r.randint(0, 900)}", r.choice([r.randint(-3, 9) / 4, float(r.randint(0, 1))])) for i in range(6000)]
    data += [(None, "i", 1.0), ("g1", None, 1.0), ("g1", "i", None), ("g1", "nan", float("nan")), ("inf", "a", float("inf")), ("inf", "b", float("-inf"))]
    df = spark.createDataFrame(data, "g string, i string, s double")
    best = {}
    for g, i, s in data:
        if None not in (g, i, s) and s == s:
            best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, -math.inf))
    want = sorted((g, i, s, k) for g, x in best.items() for k, (i, s) in enumerate(sorted(x.items(), key=lambda y: (-y[1], y[0]))[:5], 1))
    assert rows(topn.top_n(df, "g", "i", "s", 5, row_group_bytes=4096)) == want
    assert topn.top_n(df.limit(0), "g", "i", "s", 5).count() == 0


def test_row_groups_are_skipped(tmp_path):
    import pyarrow as pa

    hot = [("hot", f"i{k:05d}", float(9000 - k)) for k in range(9000)] + [("z", "a", 1.0)]
    table = pa.table({"g": [x[0] for x in hot], "i": [x[1] for x in hot], "s": [x[2] for x in hot]})
    pq.write_table(table, tmp_path / "f.parquet", row_group_size=500)
    best, skipped = topn.best_of_file(pq.ParquetFile(tmp_path / "f.parquet"), 3)
    assert skipped == 17 and best["i"].tolist() == ["i00000", "i00001", "i00002", "a"]
    ties = pa.table({"g": ["t"] * 1000, "i": [f"i{k:04d}" for k in range(1000)], "s": [1.0] * 1000})
    pq.write_table(ties, tmp_path / "t.parquet", row_group_size=100)
    best, skipped = topn.best_of_file(pq.ParquetFile(tmp_path / "t.parquet"), 3)
    assert skipped == 0 and best["i"].tolist() == ["i0000", "i0001", "i0002"]


# similar sets


def jaccard_sets(sets, threshold):
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("limit", [48, 6])
def test_similar_sets(spark, limit):
    r = random.Random(6)
    sets = {f"s{i:03d}": {f"t{int(200 * r.random() ** 2)}" for _ in range(r.randint(3, 14))} for i in range(150)}
    for i in range(40):
        base = sorted(sets[f"s{i:03d}"])
        sets[f"v{i:03d}"] = set(base[: max(2, len(base) - r.randint(0, 4))]) | {f"new{i}"}
        sets[f"w{i:03d}"] = set(base)
    sets |= {f"h{i}": {"t0", "t1", "t2", "t3", f"own{i}"} for i in range(60)}
    data = [(k, t) for k, s in sets.items() for t in s] * 2 + [(None, "t0"), ("s000", None)]
    pairs, classes = setjoin.similar_sets(spark.createDataFrame(data, "r string, t string"), "r", "t", 0.5, limit=limit)
    got = {tuple(x) for x in setjoin.expand(pairs, classes).collect()}
    assert got == jaccard_sets(sets, 0.5)
    assert len({x.rep for x in classes.collect()}) == len({frozenset(s) for s in sets.values()})


def test_similar_sets_edges(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "r string, t string")
    pairs, classes = setjoin.similar_sets(df, "r", "t", 0.5, least=2)
    assert pairs.count() == 0 and rows(classes) == [("b", "b")]
    pairs, _ = setjoin.similar_sets(df, "r", "t", 0.5)
    assert [(x.r1, x.r2, x.common, x.n1, x.n2) for x in pairs.collect()] == [("a", "b", 1, 1, 2)]
    pairs, classes = setjoin.similar_sets(df.limit(0), "r", "t", 0.5)
    assert pairs.count() == classes.count() == 0
    other = spark.createDataFrame([("q", "x"), ("q", "y")], "r string, t string")
    between, classes = setjoin.similar_sets_between(df, other, "r", "t", 0.5)
    assert {(x.r1, x.r2) for x in between.collect()} == {("l:a", "l:b")} and dict(rows(classes))["r:q"] == "l:b"


def test_depth_grows_with_a_hot_token(spark, monkeypatch):
    """One token in all of 20,000 sets: nodes are split until they are small, and none is compared in blocks."""
    def rows_of(n):
        return spark.range(n).select(F.col("id").alias("r"), F.explode(F.concat(F.array(F.lit(-1).cast("bigint")), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.xxhash64(F.col("id"), k)))).alias("t"))

    def depth(n):
        return setjoin.depth_for(rows_of(n).select(F.lit(6).alias("size"), F.xxhash64("t").alias("h")), 0.5, 48)

    assert depth(20) == 1 and 2 < depth(2000) < depth(20_000) < setjoin.DEEPEST
    monkeypatch.setattr(setjoin, "_blocks", lambda *a: pytest.fail("blocks"))
    twins = rows_of(20_000).where("r < 30 and t <> -1").withColumn("r", F.col("r") + 100_000)
    pairs, _ = setjoin.similar_sets(rows_of(20_000).unionByName(twins), "r", "t", 0.8)
    assert sorted((x.r1, x.r2) for x in pairs.collect()) == [(k, k + 100_000) for k in range(30)]


def test_trees_for_recall():
    assert setjoin.trees_for(0.99) < setjoin.trees_for(0.9999) < 40


# n-grams


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_ngrams(spark, monkeypatch, depth):
    monkeypatch.setattr(ngrams, "BLOCK_TERMS", 50)
    r = random.Random(depth)
    texts = [" ".join(r.choices(["a", "b", "cc", "D", "1"], k=r.randint(0, 12))) for _ in range(120)]
    data = [(f"r{i}", t) for i, t in enumerate(texts)] + [("r0", texts[0]), ("n", None), ("e", ""), ("p", "...!")]
    count, docs = Counter(), Counter()
    for t in texts:
        w = "".join(c if "a" <= c <= "z" else " " for c in t.lower()).split()
        grams = [" ".join(w[i : i + n]) for n in range(1, depth + 1) for i in range(len(w) - n + 1)]
        count.update(grams)
        docs.update(set(grams))
    df = spark.createDataFrame(data, "gram string, records string")
    got = {x.gram: (x.n, x.occurrences, x.records) for x in ngrams.ngram_counts(df, "gram", "records", depth).collect()}
    assert got == {g: (g.count(" ") + 1, n, docs[g]) for g, n in count.items()}
    assert ngrams.ngram_counts(df.limit(0), "gram", "records", depth).count() == 0
    assert ngrams.all_records(df, "gram", "records").first().n == 122


def test_suffix_order():
    r = np.random.default_rng(1)
    code = np.append(r.integers(0, 3, 300), -1)
    for depth in (1, 2, 3, 5, 8):
        order = ngrams.suffix_order(code, depth).tolist()
        assert order == sorted(range(301), key=lambda i: (code[i : i + depth].tolist() + [-9] * (depth - len(code[i : i + depth])), i))


def test_marks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "gram string, records bigint")
    assert {x.gram: x.mark for x in ngrams.mark_frequency(df, 10, 2, 0.3).collect()} == {"a": "rare", "b": "rare", "c": None, "d": "common"}


# leaks


def test_words_as_displayed():
    same = ["Crème brûlée, half an HOUR passed", "<p>Cr&egrave;me <b>br&#251;l&eacute;e</b>;<br/>half&nbsp;an ho­ur pas​sed</p>", "creme brulee half-\n an hour".replace("half-\n an", "half an") + " pas-\nsed", "ＣＲＥＭＥ brulee — half… an  hour\tpassed<!-- x --><script>y()</script>"]
    assert len({tuple(leaks.words_of(t)) for t in same}) == 1
    assert leaks.words_of("") == leaks.words_of("<br>") == [] and leaks.words_of("a < b & c") == ["a", "b", "c"]


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    items = [(i, [word() for _ in range(r.randint(5, 40))]) for i in range(30)] + [(30, ["same"] * 20)]
    docs = [(0, None), (1, ""), (2, "same " * 14), (3, "same " * 12)]
    for d in range(4, 300):
        w = [word() for _ in range(r.choice([0, 3, 10, 60, 400]))]
        _, x = r.choice(items)
        n = r.choice([11, 12, 13, 14, 20])
        a = r.randint(0, max(0, len(x) - n))
        at = r.randint(0, len(w))
        docs.append((d, " ".join(w[:at] + x[a : a + n] + w[at:])))
    docs.append((1000, " ".join([word() for _ in range(20000)] + items[0][1] * 3)))
    passages = {}
    for i, x in items:
        for k in range(len(x) - 12):
            passages.setdefault(tuple(x[k : k + 13]), set()).add(i)
    want = set()
    for d, t in docs:
        w = (t or "").split()
        for k in range(len(w) - 12):
            want |= {(d, i) for i in passages.get(tuple(w[k : k + 13]), ())}
    df = spark.createDataFrame([*docs, docs[10]], "item bigint, doc string")
    held = spark.createDataFrame([(i, " ".join(x)) for i, x in items] + [(None, "x"), (77, None)], "doc bigint, item string")
    found = leaks.find_leaks(df, "item", "doc", held, "doc", "item")
    assert {(x.doc, x.item) for x in found.collect()} == want and len(want) > 60
    assert {x.longest for x in found.where("doc = 2").collect()} == {14}
    assert leaks.find_leaks(df.limit(0), "item", "doc", held, "doc", "item").count() == 0
    assert leaks.find_leaks(df, "item", "doc", held.limit(0), "doc", "item").count() == 0


@pytest.mark.parametrize("most_bits", [1 << 19, 1 << 29])
def test_full_filter(spark, monkeypatch, most_bits):
    """A filter that lets nearly everything through changes nothing."""
    monkeypatch.setattr(leaks, "MOST_BITS", most_bits)
    monkeypatch.setattr(leaks, "BITS_EACH", 1)
    texts = [" ".join(f"w{i}x{k}" for k in range(15)) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    assert rows(leaks.find_leaks(df, "id", "t", df, "id", "t")) == [(i, i, 15) for i in range(200)]


def test_filter_lets_all_of_the_index_through(spark):
    numbers = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 5000)
    table, bits = leaks.build_filter(spark.createDataFrame([(int(x),) for x in numbers], "number bigint"), len(numbers))
    assert leaks.passes(table, bits, numbers).all()
    others = np.random.default_rng(4).integers(-(1 << 62), 1 << 62, 50_000)
    assert leaks.passes(table, bits, others).mean() < 0.01


def test_items_of_one_id_and_short_ones(spark):
    items = spark.createDataFrame([(1, "a b c"), (1, None), (2, " ".join("abcdefghijklmno")), (2, " ".join("qrstuvwxyzabcdef"))], "id bigint, t string")
    docs = spark.createDataFrame([(5, " ".join("abcdefghijklmno")), (5, " ".join("qrstuvwxyzabcdef")), (None, "x"), (6, "a b c")], "id bigint, t string")
    assert rows(leaks.find_leaks(docs, "id", "t", items, "id", "t")) == [(5, 2, 16)]
    assert rows(leaks.item_lengths(items, "id", "t")) == [(1, 3), (2, 16)]


# mixture


def slow_apportion(weights, caps, seats):
    held = [0] * len(weights)
    for _ in range(seats):
        free = [i for i in range(len(weights)) if held[i] < caps[i] and weights[i] > 0]
        if not free:
            break
        held[min(free, key=lambda i: (-weights[i] / (2 * held[i] + 1), i))] += 1
    return held


def test_apportion():
    r = random.Random(9)
    for _ in range(400):
        n = r.randint(1, 8)
        w, c, s = [r.choice([0, 0.1, 0.2, 0.5, r.random()]) for _ in range(n)], [r.randint(0, 40) for _ in range(n)], r.randint(0, 120)
        assert mixture.apportion(w, c, s) == slow_apportion(w, c, s)
    big = mixture.apportion([0.5, 0.3, 0.2], [10**12] * 3, 10**11)
    assert sum(big) == 10**11 and big[0] == 5 * 10**10


def test_mixture(spark):
    docs = [(i, f"word {i} " * 10, ["A", " a", "b", "B ", "c", None][i % 6] if i >= 40 else "tiny") for i in range(1500)]
    docs += [(9000, None, "a"), (9001, "", "b"), (9002, "hello", "unlisted"), (9003, "long text " * 5000, "a")]
    df = spark.createDataFrame(docs, "id bigint, text string, source string").withColumn("n_tokens", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.4, 1), (" A", 0.1, 2), ("b", 0.2, 2), ("tiny", 0.25, 3), ("gone", 0.05, 4), ("zero", 0.0, 1), (None, 0.5, 1), ("null", None, None)], "source string, weight double, max_repeat bigint")
    plan = mixture.plan_mixture(df, "id", "text", "source", targets, block=64)
    assert {r["source"] for r in plan.report if r["short"]} == {"tiny", "gone"}
    chosen = mixture.mixture(plan)
    got = chosen.collect()
    most = {"a": 2, "b": 2, "tiny": 3}
    assert len({x.id for x in got}) == len(got) and all(1 <= x.copies <= most[x.source] for x in got)
    share = {x.source: x for x in mixture.shares(plan, chosen).collect()}
    assert sum(x.share for x in share.values()) == pytest.approx(1.0) and share["gone"].mixed_tokens == 0
    assert share["tiny"].mixed_tokens == 3 * share["tiny"].n_tokens
    again = mixture.mixture(mixture.plan_mixture(df.repartition(5), "id", "text", "source", targets, block=64))
    assert rows(again) == rows(chosen)
    assert rows(mixture.mixture(mixture.plan_mixture(df, "id", "text", "source", targets, block=64, seed=5))) != rows(chosen)
    none = mixture.plan_mixture(df.limit(0), "id", "text", "source", targets)
    assert none.total == 0 and mixture.mixture(none).count() == 0


def test_short_sources_are_at_their_cap(spark):
    r = random.Random(12)
    for k in range(4):
        docs = [(i, "word " * r.randint(1, 40), "abcde"[min(4, int(r.expovariate(0.7)))]) for i in range(1200)]
        goals = [(s, r.choice([0.1, 0.2, 0.4, 0.05]), r.randint(1, 4)) for s in "abcde"]
        plan = mixture.plan_mixture(spark.createDataFrame(docs, "id bigint, text string, source string"), "id", "text", "source", spark.createDataFrame(goals, "source string, weight double, max_repeat bigint"), block=16, budget=r.choice([None, 10_000]))
        budget, all_weights = plan.budget, sum(w for _, w, _ in goals)
        for g in plan.report:
            assert g["short"] == (g["n_tokens"] * g["max_repeat"] < g["weight"] / all_weights * budget)
            if g["short"]:
                blocks = sum(x.n_blocks for x in plan.shards.where(F.col("source") == g["source"]).collect())
                assert g["quota_blocks"] == blocks * g["max_repeat"]


def test_many_sources(spark, monkeypatch):
    """More sources than the driver takes are apportioned by tables, with the same result."""
    r = random.Random(3)
    docs = [(i, "word " * r.randint(0, 30), r.choice(["a", "a", "a", "B ", "c", "d", None, "other"])) for i in range(600)]
    goals = [("a", 0.3, 2), ("b", 0.3, 3), (" C", 0.1, 1), ("c", 0.1, 2), ("d", 0.2, 4), ("gone", 0.1, 2), ("zero", 0.0, 1), ("e1", 0.05, 1), ("e2", 0.05, 1)]
    df, targets = spark.createDataFrame(docs, "id bigint, text string, source string"), spark.createDataFrame(goals, "source string, weight double, max_repeat bigint")

    def all_of():
        out = []
        for budget in (None, 3_000, 10**7):
            plan = mixture.plan_mixture(df, "id", "text", "source", targets, block=16, budget=budget)
            chosen = mixture.mixture(plan)
            out.append((rows(plan.table), rows(chosen), [tuple(x) for x in rows(mixture.shares(plan, chosen).select("source", "mixed_tokens", F.round("share", 9)))]))
        return out

    few = all_of()
    monkeypatch.setattr(mixture, "MOST_SOURCES", 2)
    assert all_of() == few


def test_hot_terms(spark, monkeypatch):
    df = spark.createDataFrame([(f"b{i}", f"r{i}", f"the w{i % 7} and all x" + "yz"[i % 2]) for i in range(60)], "b string, p string, t string")
    few = rows(terms.distinctive_terms(df, "b", "p", "t"))
    monkeypatch.setattr(terms, "FREQUENT", 2)
    assert rows(terms.distinctive_terms(df, "b", "p", "t")) == few


def test_shares_meet_weights(spark):
    docs = [(i, "some words here " * 8, "abc"[i % 3]) for i in range(3000)]
    targets = spark.createDataFrame([("a", 0.5, 9), ("b", 0.3, 9), ("c", 0.2, 9)], "source string, weight double, max_repeat bigint")
    plan = mixture.plan_mixture(spark.createDataFrame(docs, "id bigint, text string, source string"), "id", "text", "source", targets)
    share = {x.source: x.share for x in mixture.shares(plan, mixture.mixture(plan)).collect()}
    assert share == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.2}, abs=0.01)


# personal information


def scored(table, names, field):
    hit, found, truth = Counter(), Counter(), Counter()
    for (_, spans), got in zip(table, pii.pieces(field, names, [t for t, _ in table])):
        hit.update(x[2] for x in set(spans) & set(got))
        found.update(x[2] for x in got)
        truth.update(x[2] for x in spans)
    return {k: (hit[k] / truth[k], hit[k] / found[k]) for k in KINDS}


def test_accuracy_on_unseen_sentences(spark):
    """Sentences of other subjects, none of which the field is trained on, filled with other names and numbers."""
    own = {s for part in (pii_table.CARRIERS, pii_table.NAMES, pii_table.OTHERS) for s in pii_table.sentences(part)}
    for texts in ((unseen.CARRIERS, unseen.NAMES, unseen.OTHERS), (unseen.FRESH_CARRIERS, unseen.FRESH_NAMES, unseen.FRESH_OTHERS)):
        parts = [pii_table.sentences(x) for x in texts]
        assert not own.intersection(s for p in parts for s in p)
        table, names = labelled_rows(1500, 92, *parts)
        got = scored(table, names, pii.train(spark))
        print(got)
        for k in KINDS:
            assert min(got[k]) > (0.8 if k == "name" else 0.85), got


def test_weights_are_stored(spark):
    first = pii.train(spark)
    pii._trained.clear()
    again = pii.train(spark)
    assert again is not first and again.features.keys() == first.features.keys()
    texts = [t for t, _ in labelled_rows(50, 5)[0]]
    assert pii.pieces(first, {}, texts) == pii.pieces(again, {}, texts)


def test_masks(spark):
    docs = [
        (1, "Call me back at (702) 555-0147. Order no. 76889694 never arrived."), (2, "signed, Marisol Underhay"), (3, None), (4, ""), (5, "rose water and basil"),
        (6, "Write to a.b@mail.example.test for refunds."), (7, "x " * 30_000 + "mail someone99@host.example if you find my scarf"), (1, "Call me back at (702) 555-0147. Order no. 76889694 never arrived."),
    ]
    df = spark.createDataFrame(docs, "kind bigint, surface string")
    names = spark.createDataFrame([("Marisol", "given"), ("Underhay", "family"), (None, "given"), ("Rose", "given")], "name string, name_part string")
    got = {x.doc: x for x in pii.mask_pii(df, "kind", "surface", names).collect()}
    assert got[1].text == "Call me back at [PHONE]. Order no. 76889694 never arrived." and got[2].text == "signed, [NAME]" and got[3].text is None
    assert got[4].text == "" and got[5].text == "rose water and basil" and got[6].text == "Write to [EMAIL] for refunds." and got[7].text.endswith("mail [EMAIL] if you find my scarf")
    found = pii.find_pii(df, "kind", "surface", names)
    assert found.where("doc = 1").count() == 2 and {(x.kind, x.surface) for x in found.where("doc = 2").collect()} == {("name", "Marisol Underhay")}
    for x in found.where("doc < 7").collect():
        assert dict(docs)[x.doc][x.start : x.end] == x.surface
    assert pii.find_pii(df.limit(0), "kind", "surface", names.limit(0)).count() == 0


def test_viterbi_is_the_best_path():
    field = pii.train()
    texts = pii.Texts(["call Ann Lee", "x", "", "no 12 5551234", "Mr. O. Roe 9"])
    score, found = field.scores(texts, {}), field.decode(texts, {})
    for a, n in zip(texts.first.tolist(), texts.sizes.tolist()):
        best = max(itertools.product(range(len(pii.LABELS)), repeat=n), key=lambda y: sum(score[a + i, k] for i, k in enumerate(y)) + sum(field.moves[i, j] for i, j in zip((0, *y), (*y, 0))))
        assert found[a : a + n].tolist() == list(best)


def test_certain_tokens_change_nothing(monkeypatch):
    """The decoder that leaves out certain tokens equals the one that leaves out none."""
    field, (table, names) = pii.train(), labelled_rows(200, 31)
    texts = [t for t, _ in table]
    short = pii.pieces(field, names, texts)
    monkeypatch.setattr(pii.Field, "_slack", lambda self, score: np.full(len(score), np.inf))
    assert pii.pieces(field, names, texts) == short


def test_long_list_of_names(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Signed, Wexlan Orp"), (2, None), (3, ""), (4, "Mr. Wexlan left. Orp came."), (4, "Mr. Wexlan left. Orp came.")], "d bigint, t string")
    names = spark.createDataFrame([("Wexlan", "given"), ("Orp", "family"), ("Orp", "given"), ("Wexlan", "given"), (None, "family")], "name string, name_part string")
    few = rows(pii.mask_pii(docs, "d", "t", names)), rows(pii.find_pii(docs, "d", "t", names))
    monkeypatch.setattr(pii, "MOST_NAMES", 1)
    many = rows(pii.mask_pii(docs, "d", "t", names)), rows(pii.find_pii(docs, "d", "t", names))
    assert [[x for x in m if x[1] is not None] for m in many] == [[x for x in f if x[1] is not None] for f in few]
