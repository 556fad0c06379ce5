"""Similarity and selection of policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.num import div
from tickloom.session import materialize

# Members of a class that travel in one list.
BLOCK = 1024


def genome_pairs(genes: DataFrame, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """Number of shared features per policy pair that shares any: an equi-join on the feature.

    ``genes(policy_id, feature)``.  A feature many policies use makes many pairs by nature of the question; the
    join is partitioned by (feature, salt of the left policy), so one popular feature does not land in one task.
    """
    salts = 16
    a = genes if left is None else genes.join(left, "policy_id", "left_semi")
    b = genes if right is None else genes.join(right, "policy_id", "left_semi")
    a = a.select(F.col("policy_id").alias("p1"), "feature", F.pmod(F.xxhash64("policy_id"), F.lit(salts)).alias("salt"))
    b = b.select(F.col("policy_id").alias("p2"), "feature", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))
    return a.join(b, ["feature", "salt"]).filter(F.col("p1") != F.col("p2")).groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("shared"))


def jaccard(genes: DataFrame, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """Jaccard similarity of feature sets for pairs with something in common (all other pairs are 0)."""
    size = genes.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n"))
    s1, s2 = size.toDF("p1", "n1"), size.toDF("p2", "n2")
    j = genome_pairs(genes, left, right).join(s1, "p1").join(s2, "p2")
    return j.select("p1", "p2", (F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).alias("jaccard"))


def genomes_of(genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct feature sets ``(genome, features)`` and which policy has which: ``(policy_id, genome)``.

    Repeated rows of ``genes`` count once; a policy without features or a null feature has no genome.
    """
    sets = genes.filter("feature IS NOT NULL").groupBy("policy_id").agg(F.array_sort(F.collect_set("feature")).alias("features"))
    sets = materialize(sets.withColumn("genome", F.sha2(F.to_json("features"), 256)))
    return sets.groupBy("genome").agg(F.first("features").alias("features")), sets.select("policy_id", "genome")


def candidate_genomes(genomes: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(g1 < g2)`` of genomes that may have a Jaccard similarity above ``threshold``.

    Features are ordered from rare to frequent. Two sets of n1 and n2 features above the threshold share at least
    t / (1 + t) * (n1 + n2) of them, so they meet in the first n - ceil(t n) + 1 of either; only these are joined. Lengths
    further apart than the threshold allows are left out, and so are meetings after which too few features remain.
    """
    eps = 1e-9
    each = materialize(genomes.select("genome", F.size("features").alias("n"), F.explode("features").alias("feature")))
    rarity = each.groupBy("feature").agg(F.count(F.lit(1)).alias("f"))
    ranked = each.join(rarity, "feature").groupBy("genome", "n").agg(F.array_sort(F.collect_list(F.struct("f", "feature"))).alias("o"))
    head = (F.col("n") - F.ceil(F.col("n") * threshold - eps) + 1).cast("int")
    prefix = ranked.select("genome", "n", F.posexplode(F.slice("o", F.lit(1), F.least(head, F.col("n")))).alias("pos", "x"))
    prefix = materialize(prefix.select("genome", "n", "pos", F.col("x.feature").alias("feature")))
    a, b = prefix.toDF("g1", "n1", "pos1", "feature"), prefix.toDF("g2", "n2", "pos2", "feature")
    j = a.join(b, "feature").filter("g1 < g2").filter((F.col("n2") >= F.col("n1") * threshold - eps) & (F.col("n1") >= F.col("n2") * threshold - eps))
    most = F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2"))
    return j.filter(most >= (F.col("n1") + F.col("n2")) * (threshold / (1 + threshold)) - eps).select("g1", "g2").distinct()


def similar_genomes(genomes: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(g1 < g2, jaccard)`` of distinct genomes above ``threshold``, compared on their full sets."""
    s1, s2 = genomes.toDF("g1", "s1"), genomes.toDF("g2", "s2")
    j = candidate_genomes(genomes, threshold).join(s1, "g1").join(s2, "g2")
    shared = F.size(F.array_intersect("s1", "s2"))
    return j.select("g1", "g2", (shared / (F.size("s1") + F.size("s2") - shared)).alias("jaccard")).filter(F.col("jaccard") > threshold)


def similar_policies(genes: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(p1 < p2, jaccard)`` of policies above ``threshold`` (0 to 1): pairs of genomes, then their policies."""
    genomes, members = genomes_of(genes)
    both = materialize(similar_genomes(genomes, threshold))
    m1, m2 = members.toDF("p1", "g1"), members.toDF("p2", "g2")
    cross = both.join(m1, "g1").join(m2, "g2").select(F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2"), "jaccard")
    same = m1.join(m2, F.col("g1") == F.col("g2")).filter("p1 < p2").select("p1", "p2", F.lit(1.0).alias("jaccard"))
    return cross.unionByName(same.filter(F.lit(threshold < 1)))


def batch_similarity(genes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Mean Jaccard and collision rate over all unordered pairs of policies.

    Policies with the same feature set are collapsed to one weighted genome first, so a third of the batch being
    copies costs one row; genomes with nothing in common count as 0 without being listed.
    """
    sets = genes.groupBy("policy_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("feature"))).alias("genome"))
    genomes = materialize(sets.groupBy("genome").agg(F.count(F.lit(1)).alias("w")))
    each = genomes.select(F.col("genome").alias("policy_id"), F.explode(F.split("genome", ",")).alias("feature"))
    w1, w2 = genomes.toDF("p1", "w1"), genomes.toDF("p2", "w2")
    cross = jaccard(each).filter(F.col("p1") < F.col("p2")).join(w1, "p1").join(w2, "p2").select(
        (F.col("w1") * F.col("w2")).alias("pairs"), "jaccard", F.lit(0).alias("n"))
    same = genomes.select((F.col("w") * (F.col("w") - 1) / 2).alias("pairs"), F.lit(1.0).alias("jaccard"), F.col("w").alias("n"))
    t = cross.select(F.col("pairs").cast("double"), "jaccard", "n").unionByName(same).agg(
        F.sum(F.col("pairs") * F.col("jaccard")).alias("s"), F.sum(F.when(F.col("jaccard") > threshold, F.col("pairs")).otherwise(0.0)).alias("hits"), F.sum("n").alias("n"))
    total = F.col("n") * (F.col("n") - 1) / 2
    return t.select(F.coalesce(div("s", total), F.lit(0.0)).alias("avg_jaccard"), F.coalesce(div("hits", total), F.lit(0.0)).alias("collision_rate"))


def param_similarity(params: DataFrame, pairs: DataFrame) -> DataFrame:
    """1 - mean relative distance over the parameters both policies of a pair give to common features."""
    a = params.select(F.col("policy_id").alias("p1"), "feature", "param", F.col("value").alias("v1"))
    b = params.select(F.col("policy_id").alias("p2"), "feature", "param", F.col("value").alias("v2"))
    j = pairs.select("p1", "p2").join(a, "p1").join(b, ["p2", "feature", "param"])
    d = F.abs(F.col("v1") - F.col("v2")) / F.greatest(F.abs("v1"), F.abs("v2"), F.lit(1e-6))
    return j.groupBy("p1", "p2").agg(F.greatest(F.lit(0.0), 1 - F.avg(d)).alias("param_similarity"))


def param_classes(genes: DataFrame, params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(policy_id, cls, genome)`` and ``params`` of the classes alone, with ``cls`` as policy_id.

    A class has one genome and one list of parameters (repeated rows counted); it is named after its smallest policy.
    """
    _, members = genomes_of(genes)
    lists = params.groupBy("policy_id").agg(F.array_sort(F.collect_list(F.struct("feature", "param", "value"))).alias("l"))
    each = materialize(members.join(lists.select("policy_id", F.sha2(F.to_json("l"), 256).alias("list")), "policy_id"))
    names = each.groupBy("genome", "list").agg(F.min("policy_id").alias("cls"))
    classed = materialize(each.join(names, ["genome", "list"]).select("policy_id", "cls", "genome"))
    own = params.join(classed.select("cls").distinct().withColumnRenamed("cls", "policy_id"), "policy_id", "left_semi")
    return classed, materialize(own)


def similar_params(genes: DataFrame, params: DataFrame, threshold: float) -> DataFrame:
    """``param_similarity`` of all pairs ``p1 < p2`` of policies whose Jaccard similarity is above ``threshold`` (0 to 1).

    Classes of equal policies are compared, not policies: what is moved grows with the classes, and with lists of at most about
    ``BLOCK`` members of a class for each class like it. Pairs of policies are made last, from two lists in one row, and not moved.
    """
    genes, params = materialize(genes), materialize(params)
    genomes, _ = genomes_of(genes)
    classed, own = param_classes(genes, params)
    classes = classed.select("cls", "genome").distinct()
    c1, c2 = classes.toDF("p1", "g1"), classes.toDF("p2", "g2")
    cross = similar_genomes(genomes, threshold).join(c1, "g1").join(c2, "g2").select("p1", "p2")
    same = c1.join(c2, F.col("g1") == F.col("g2")).filter("p1 <= p2").select("p1", "p2").filter(F.lit(threshold < 1))
    alike = materialize(param_similarity(own, cross.unionByName(same)))
    size = classed.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("policy_id"), F.col("blocks"))
    lists = materialize(classed.join(size, "cls").groupBy("cls", block.alias("block")).agg(F.collect_list("policy_id").alias("ids")))
    l1, l2 = lists.toDF("p1", "b1", "ids1"), lists.toDF("p2", "b2", "ids2")
    # blocks are listed by number first, so that a pair of them takes one list along and meets the other
    met = alike.join(l1, "p1").join(lists.select(F.col("cls").alias("p2"), F.col("block").alias("b2")), "p2").join(l2, ["p2", "b2"])
    one = met.select((F.col("p1") == F.col("p2")).alias("own"), "param_similarity", F.explode("ids1").alias("a"), "ids2")
    both = one.select("own", "param_similarity", "a", F.explode("ids2").alias("b")).filter(~F.col("own") | (F.col("a") < F.col("b")))
    return both.select(F.least("a", "b").alias("p1"), F.greatest("a", "b").alias("p2"), "param_similarity")


def elites_and_explorers(scored: DataFrame, genes: DataFrame, elites: int, explorers: int) -> DataFrame:
    """Top policies by score, then those of the rest least similar to any elite (ties by score, then id)."""
    order = [F.col("score").desc(), F.col("policy_id")]
    top = scored.orderBy(*order).limit(elites).select("policy_id", "score")
    rest = scored.join(top.select("policy_id"), "policy_id", "left_anti").select("policy_id", "score")
    sim = jaccard(genes, rest, top).groupBy("p1").agg(F.max("jaccard").alias("max_sim"))
    ranked = rest.join(sim, rest.policy_id == sim.p1, "left").select("policy_id", "score", F.coalesce("max_sim", F.lit(0.0)).alias("max_sim"))
    picked = ranked.orderBy("max_sim", *order).limit(explorers)
    return top.select("policy_id", "score", F.lit(0.0).alias("max_sim"), F.lit("elite").alias("role")).unionByName(
        picked.select("policy_id", "score", "max_sim", F.lit("explorer").alias("role")))


def diverse_top_k(scored: DataFrame, genes: DataFrame, params: DataFrame, k: int, jaccard_max: float = 0.7, param_gap: float = 0.1,
                  bonus: float = 0.5, seed: DataFrame | None = None) -> DataFrame:
    """Greedy selection: best score plus diversity bonus, rejecting near copies of what is already chosen.

    Each of the k rounds is one aggregation over the candidates; the chosen set (at most k rows) is the
    only thing compared against, and the similarity of a candidate to it is carried forward as a maximum.
    """
    genes, params = materialize(genes), materialize(params)  # read several times in every round
    cand = materialize(scored.select("policy_id", "score", F.lit(0.0).alias("max_sim"), F.lit(False).alias("blocked")))
    spark = scored.sparkSession
    chosen: list[tuple[str, float]] = []
    todo = [(r.policy_id, r.score) for r in seed.orderBy("rank").limit(k).collect()] if seed is not None else []
    for _ in range(k):
        if todo:
            pick = todo.pop(0)
        else:
            gain = F.col("score") + (F.lit(bonus) * (1 - F.col("max_sim")) if chosen else F.lit(0.0))
            taken = F.col("policy_id").isin([c for c, _ in chosen]) if chosen else F.lit(False)
            best = cand.filter(~F.col("blocked") & ~taken).select("policy_id", gain.alias("gain")).orderBy(F.col("gain").desc(), "policy_id").limit(1).collect()
            if not best:
                break
            pick = (best[0].policy_id, best[0].gain)
        chosen.append(pick)
        one = spark.createDataFrame([(pick[0],)], "policy_id string")
        sim = jaccard(genes, None, one)
        close = param_similarity(params, sim.filter(F.col("jaccard") > jaccard_max)).filter(F.col("param_similarity") > 1 - param_gap)
        near = sim.join(close, ["p1", "p2"], "left").select(F.col("p1").alias("policy_id"), F.col("jaccard").alias("_j"), F.col("param_similarity").isNotNull().alias("_b"))
        cand = materialize(cand.join(near, "policy_id", "left").select(
            "policy_id", "score", F.greatest("max_sim", F.coalesce("_j", F.lit(0.0))).alias("max_sim"), (F.col("blocked") | F.coalesce("_b", F.lit(False))).alias("blocked")))
    return spark.createDataFrame([(i + 1, p, float(g)) for i, (p, g) in enumerate(chosen)], "rank int, policy_id string, gain double")


def filter_diverse(candidates: DataFrame, genes: DataFrame, compatibility: DataFrame, jaccard_max: float = 0.8, floor: float = -0.3) -> DataFrame:
    """Sequential filter in ``ord``: keep a candidate unless it conflicts or is too similar to one kept before.

    Equivalent to the lexicographically first maximal independent set: a candidate is kept once all earlier
    similar ones are dropped and dropped once an earlier similar one is kept, so each round settles many.  Of
    candidates with one genome only the first can be kept (what drops it drops the others), so genomes are
    compared, not candidates.  Candidates without features are similar to nothing; ties of ``ord`` go by policy_id.
    """
    ok = candidates.join(compatibility.filter(F.col("score") < floor), "policy_id", "left_anti").select("policy_id", "ord")
    if jaccard_max >= 1:
        return ok
    genomes, members = genomes_of(genes)
    placed = materialize(ok.join(members, "policy_id", "left"))
    first = placed.filter("genome IS NOT NULL").groupBy("genome").agg(F.min(F.struct("ord", "policy_id")).alias("f")).select("genome", "f.ord", "f.policy_id")
    free, ok = placed.filter("genome IS NULL").select("policy_id", "ord"), materialize(first)
    edges = similar_genomes(genomes.join(ok, "genome", "left_semi"), jaccard_max)
    o1, o2 = (ok.select(F.col("genome").alias(f"g{k}"), F.struct("ord", "policy_id").alias(f"o{k}")) for k in (1, 2))
    linked = edges.join(o1, "g1").join(o2, "g2")
    earlier = materialize(linked.select(F.greatest("o1", "o2")["policy_id"].alias("p1"), F.least("o1", "o2")["policy_id"].alias("p2")))
    ok = ok.select("policy_id", "ord")
    state = materialize(ok.withColumn("s", F.lit(0)))  # 0 open, 1 kept, -1 dropped
    while True:  # the earliest open candidate settles in every round, so this ends
        seen = earlier.join(state.select(F.col("policy_id").alias("p2"), F.col("s").alias("s2")), "p2").groupBy("p1").agg(F.max("s2").alias("hi"), F.min("s2").alias("lo"), F.count_if(F.col("s2") == 0).alias("open"))
        nxt = state.join(seen, state.policy_id == seen.p1, "left").select(
            "policy_id", "ord", F.when(F.col("s") != 0, F.col("s")).when(F.col("hi") == 1, -1).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0).alias("s"))
        state = materialize(nxt)
        if state.filter("s = 0").limit(1).count() == 0:
            break
    return state.filter("s = 1").select("policy_id", "ord").unionByName(free)


def combination_scores(genes: DataFrame, relations: DataFrame) -> DataFrame:
    """Compatibility per policy: +0.8 per complement, -1.5 per conflict, -0.3 per pair of one category, over n, in [-1, 1].

    ``relations(f1, f2, kind)`` lists unordered pairs with f1 < f2.
    """
    a = genes.select("policy_id", F.col("feature").alias("f1"))
    b = genes.select("policy_id", F.col("feature").alias("f2"))
    pairs = a.join(b, "policy_id").filter(F.col("f1") < F.col("f2"))
    rel = relations.groupBy("f1", "f2").agg(F.bool_or(F.col("kind") == "complement").alias("comp"), F.bool_or(F.col("kind") == "conflict").alias("conf"))
    same = F.split("f1", "_")[0] == F.split("f2", "_")[0]
    gain = (F.when(F.col("comp"), 0.8).otherwise(0.0) - F.when(F.col("conf"), 1.5).otherwise(0.0) - F.when(same, 0.3).otherwise(0.0))
    total = pairs.join(rel, ["f1", "f2"], "left").groupBy("policy_id").agg(F.sum(gain).alias("s"))
    n = genes.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n"))
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0)) / F.col("n")))
    out = n.join(total, "policy_id", "left").select("policy_id", "n", score.alias("score"))
    return out.withColumn("status", F.when(F.col("n") < 2, "NEUTRAL").when(F.col("score") < -0.2, "CONFLICTED").when(F.col("score") > 0.4, "SYNERGETIC").otherwise("HEALTHY"))
