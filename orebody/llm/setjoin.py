"""All similar pairs between set-valued records by chosen-path splitting.

Records with equal sets are one class, represented by its least id. In each of several trees a record goes from a node to
the children named by some of its tokens: token j is chosen where a hash of (node, j) is below 1 / (threshold * size); a
token may be chosen again, or what is left of two similar sets would be less alike at each level. Two sets above the threshold share on average at least one child at each level, so by the theory of branching
processes a tree brings them together in a node of depth k with a probability of about 1 / (k + 1) or more. Nodes of few
records are compared pair by pair; larger ones are split again, as often as the data need (depth_for); what is still large
at the last level is compared in blocks, so no candidate is dropped. Comparison first bounds the overlap from sizes and 256-bit token maps (a bound that
never rejects a true pair) and then counts it exactly by joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.operators.skew import TASK, plan_load, skew_join
from orebody.plans.session import materialise

NODE_LIMIT = 48
#: Deeper trees than that are not built: sets of so few tokens that they are never split are compared in blocks.
DEEPEST = 12
MAPS = ["b0", "b1", "b2", "b3"]


def depth_for(tokens: DataFrame, threshold: float, limit: int) -> int:
    """Levels after which no node is expected to hold more than half the limit: of the records with a token each goes on with
    it with a probability of 1 / (threshold * size). tokens has size and h, one row for each member."""
    stay = F.least(F.lit(1.0), 1 / (threshold * F.col("size")))
    sums = tokens.groupBy("h").agg(*(F.sum(F.pow(stay, F.lit(k))).alias(f"k{k}") for k in range(1, DEEPEST)))
    most = sums.agg(*(F.coalesce(F.max(f"k{k}"), F.lit(0.0)) for k in range(1, DEEPEST))).first()
    return next((k for k, m in enumerate(most, 1) if m <= limit / 2), DEEPEST)


def trees_for(recall: float, depth: int = 4) -> int:
    """Trees needed so that a pair at the threshold meets with the given probability at the given depth."""
    meets = 1.0
    for _ in range(depth):
        meets = 1 - math.exp(-meets)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def sets_of(df: DataFrame, record: str, token: str) -> DataFrame:
    """Distinct (r, t): the sets in long form; nulls are no members."""
    return df.select(F.col(record).alias("r"), F.col(token).alias("t")).where("r is not null and t is not null").distinct()


def _profiles(members: DataFrame) -> DataFrame:
    """Per record: size, map of its tokens, and a 128-bit signature that is equal for equal sets."""
    h = F.xxhash64("t", F.lit(11))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftrightunsigned(h, 8).bitwiseAND(F.lit(3))
    return members.groupBy("r").agg(
        F.count("*").alias("size"),
        *(F.bit_or(F.when(word == i, bit).otherwise(0)).alias(m) for i, m in enumerate(MAPS)),
        F.bit_xor(F.xxhash64("t", F.lit(12))).alias("s0"), F.bit_xor(F.xxhash64("t", F.lit(13))).alias("s1"),
    )


def _unit(*of: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / F.lit(float(1 << 53))


def _close(a: str, b: str, threshold: float) -> Column:
    """False only for pairs whose sizes or token maps prove them less similar than the threshold."""
    total = F.col(f"{a}.size") + F.col(f"{b}.size")
    differ = sum((F.bit_count(F.col(f"{a}.{m}").bitwiseXOR(F.col(f"{b}.{m}"))) for m in MAPS[1:]), F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))))
    least, most = F.least(F.col(f"{a}.size"), F.col(f"{b}.size")), F.greatest(F.col(f"{a}.size"), F.col(f"{b}.size"))
    # of u tokens in either set at most (1 - threshold) * u are in one only, and u <= total / (1 + threshold)
    return (least >= most * threshold - 1e-9) & (differ <= total * ((1 - threshold) / (1 + threshold)) + 1e-9)


def _pairs_within(nodes: DataFrame, threshold: float) -> DataFrame:
    a, b = nodes.alias("a"), nodes.alias("b")
    met = a.join(b.hint("shuffle_merge"), (F.col("a.node") == F.col("b.node")) & (F.col("a.r") < F.col("b.r")) & _close("a", "b", threshold))
    return met.select(F.col("a.r").alias("r1"), F.col("b.r").alias("r2"))


def _blocks(nodes: DataFrame, limit: int) -> DataFrame:
    """Large nodes as pairs of blocks: each record is in one block and meets every block of its node, in bounded nodes."""
    size = nodes.groupBy("node").agg(F.count("*").alias("n"))
    k = nodes.join(size, "node").withColumn("parts", F.ceil(F.col("n") / limit).cast("int"))
    k = k.withColumn("part", F.pmod(F.xxhash64("r", F.lit(17)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    k = k.withColumn("other", other)
    return k.withColumn("node", F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other"))).drop("n", "parts", "part", "other")


def candidate_pairs(members: DataFrame, profiles: DataFrame, threshold: float, recall: float, limit: int = NODE_LIMIT) -> DataFrame:
    """Distinct (r1, r2), r1 < r2, that met in a node and may be similar. members and profiles must be stored tables. Records of
    many tokens and nodes of many records are spread over tasks wherever they are joined."""
    p = profiles.select("r", "size", *MAPS)
    plan = plan_load(members, ["r"])
    tokens = materialise(skew_join(members, p.select("r", "size"), plan, ["t"]).select("r", "size", F.xxhash64("t", F.lit(21)).alias("h")), "tokens")
    depth = depth_for(tokens, threshold, limit)
    trees = trees_for(recall, depth)
    chosen = tokens.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(_unit(F.col("tree"), F.col("h")) < 1 / (threshold * F.col("size")))
    level = chosen.select(F.xxhash64("tree", "h").alias("node"), "r")
    out = None
    for k in range(1, depth + 1):
        level = materialise(level, "level")
        held = level.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        level = materialise(skew_join(level, held, plan_load(level, ["node"]), ["r"]).drop(TASK), "nodes")
        small = level.where(F.col("n") <= limit).join(p, "r")
        found = materialise(_pairs_within(small, threshold).distinct(), "pairs")
        out = found if out is None else out.unionByName(found)
        large = level.where(F.col("n") > limit).drop("n")
        if large.isEmpty():
            break
        if k == depth:
            out = out.unionByName(_pairs_within(_blocks(large.join(p, "r"), limit), threshold))
            break
        level = skew_join(tokens, large, plan, ["h"]).where(_unit(F.col("node"), F.col("h")) < 1 / (threshold * F.col("size")))
        level = level.select(F.xxhash64("node", "h").alias("node"), "r")
    return out.distinct()


def verify(pairs: DataFrame, members: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """(r1, r2, common, n1, n2) of the pairs whose exact similarity reaches the threshold. A record of many pairs is spread."""
    s = profiles.select("r", "size")
    sized = pairs.join(s.select(F.col("r").alias("r1"), F.col("size").alias("n1")), "r1").join(s.select(F.col("r").alias("r2"), F.col("size").alias("n2")), "r2")
    first = F.col("n1") <= F.col("n2")
    probe = materialise(sized.select("*", F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.when(first, F.col("r2")).otherwise(F.col("r1")).alias("big")), "probe")
    both = skew_join(probe, members, plan_load(probe, ["r"]), ["big"]).join(members.select(F.col("r").alias("big"), "t"), ["big", "t"])
    shared = both.groupBy("r1", "r2", "n1", "n2").agg(F.count("*").alias("common"))
    # the threshold in whole numbers up to 1e-9, so that a pair exactly on it counts
    return shared.where(F.col("common") >= threshold * (F.col("n1") + F.col("n2") - F.col("common")) - 1e-9)


def similar_sets(df: DataFrame, record: str, token: str, threshold: float, least: int = 1, recall: float = 0.9999, limit: int = NODE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes): pairs (r1, r2, common, n1, n2) between class representatives, r1 < r2, and classes (r, rep) with
    one row for each record of at least `least` tokens. Members of one class are equal sets, similar to each other.

    Nulls are no members and no records; repeated members count once; an empty table gives no pairs and no classes. Pairs
    have exact figures; a pair at the threshold is found with probability `recall` or more, others with a higher one."""
    members = materialise(sets_of(df, record, token), "members")
    everyone = materialise(_profiles(members).where(F.col("size") >= least), "profiles")
    classes = everyone.groupBy("size", *MAPS, "s0", "s1").agg(F.min("r").alias("rep"))
    rep = materialise(everyone.join(classes, ["size", *MAPS, "s0", "s1"]).select("r", "rep", "size", *MAPS), "classes")
    heads = rep.where("r = rep").drop("rep")
    own = materialise(members.join(heads.select("r"), "r", "left_semi"), "sets")
    pairs = candidate_pairs(own, heads, threshold, recall, limit)
    return verify(pairs, own, heads, threshold), rep.select("r", "rep")


def similar_sets_between(left: DataFrame, right: DataFrame, record: str, token: str, threshold: float, least: int = 1, recall: float = 0.9999) -> tuple[DataFrame, DataFrame]:
    """As similar_sets for pairs between two tables with the same columns: records are structs (side, id), and a pair has
    one representative of each side; a class may have members of both sides, which are similar to each other."""
    both = left.select(F.concat(F.lit("l:"), F.col(record).cast("string")).alias("r"), F.col(token).alias("t")).unionByName(
        right.select(F.concat(F.lit("r:"), F.col(record).cast("string")).alias("r"), F.col(token).alias("t"))
    )
    pairs, classes = similar_sets(both, "r", "t", threshold, least, recall)
    sides = classes.groupBy("rep").agg(F.max(F.col("r").startswith("l:")).alias("l"), F.max(F.col("r").startswith("r:")).alias("r"))
    a, b = (sides.select(F.col("rep").alias(f"r{i}"), F.col("l").alias(f"l{i}"), F.col("r").alias(f"s{i}")) for i in (1, 2))
    crossed = pairs.join(a, "r1").join(b, "r2").where("(l1 and s2) or (l2 and s1)")
    return crossed.drop("l1", "s1", "l2", "s2"), classes


def expand(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(r1, r2), r1 < r2: pairs of records, those between and those within classes. As large as the result is."""
    a, b = (classes.select(F.col("rep").alias(f"p{i}"), F.col("r").alias(f"m{i}")) for i in (1, 2))
    between = pairs.select(F.col("r1").alias("p1"), F.col("r2").alias("p2")).join(a, "p1").join(b, "p2")
    within = a.join(b, (F.col("p1") == F.col("p2")) & (F.col("m1") < F.col("m2")))
    both = between.select("m1", "m2").unionByName(within.select("m1", "m2"))
    return both.select(F.least("m1", "m2").alias("r1"), F.greatest("m1", "m2").alias("r2"))
