"""Clusters of mutually similar records (problem 4): similarity links, then parallel pivot correlation clustering."""

from __future__ import annotations

from collections import Counter
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.operators.skew import join_stats
from lexforge.session import cut, drop


def copy_classes(records: DataFrame) -> DataFrame:
    """record_id, content -> class_id (the least record_id), content, members: records of equal content are one class."""
    return records.groupBy("content").agg(F.min("record_id").alias("class_id"), F.count("*").alias("members"))


BLOCK = 4096  # classes of one signature that one task may pair
_BUCKETS = 1 << 20


def set_links(classes: DataFrame, threshold: Fraction = Fraction(3, 5), block: int = BLOCK) -> DataFrame:
    """a, b (a < b), similarity: all pairs of classes whose term sets (content ARRAY<STRING>) have Jaccard >= threshold.

    Exact. Terms are ordered from rare to common. Two sets x, y at the threshold share at least
    ceil(threshold * |x|) and ceil(threshold * |y|) terms; if that is two or more for both, the two rarest of the
    terms they share lie in the first |x| - ceil(threshold * |x|) + 2 terms of x, and of y likewise. So pairs of
    terms of that prefix serve as signatures, which stay rare where single terms become frequent with the number
    of records. All further shared terms come after these two, so the places of the second bound from above what two
    sets can share; pairs whose sizes or places can't reach the threshold are no candidates. Sets of one term only
    match equal sets, which are one class already (threshold > 1/2 is required).

    Signatures of terms frequent enough are counted by hash bucket. In a bucket of more than `block` rows these are dealt into blocks by class,
    and every two blocks meet under a key of their own, so no task pairs more than two blocks of a signature. At most
    2^20 buckets are broadcast.
    """
    if not Fraction(1, 2) < threshold <= 1:
        raise ValueError("threshold must be over 1/2 and at most 1")
    num, den = threshold.numerator, threshold.denominator
    terms = classes.filter(F.size("content") > 1).select("class_id", F.size("content").alias("size"), F.explode("content").alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    ranked = join_stats(terms, df, "term", "df", "class_id").groupBy("class_id", "size").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("t"))
    length = F.expr(f"size - int(ceil({num}L * size / {den}D - 1e-9)) + 2")
    head = ranked.select("class_id", "size", F.slice("t", F.lit(1), length).alias("t"))
    # a signature is no more frequent than its rarer term, the first; terms from place `rare` on may make hot ones
    prefix = cut(head.select("class_id", "size", F.transform("t", lambda x: F.xxhash64(x["term"])).alias("p"), F.size(F.filter("t", lambda x: x["df"] <= block)).alias("rare")), "prefix")

    def signatures(rows: DataFrame) -> DataFrame:
        first = rows.select("class_id", "size", "rare", "p", F.posexplode("p").alias("i", "h"))
        both = first.select("class_id", "size", "rare", "i", "h", F.posexplode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("k", "g"))
        return both.select(F.xxhash64("h", "g").alias("sig"), "class_id", "size", (F.col("i") + F.col("k") + 1).alias("at"), (F.col("i") >= F.col("rare")).alias("often"))

    bucket = F.pmod("sig", F.lit(_BUCKETS)).cast("int")
    often = signatures(prefix.filter(F.col("rare") < F.size("p") - 1)).filter("often")
    full = often.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).filter(F.col("n") > block).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.lit(True).alias("often"))
    keyed = signatures(prefix)
    dealt = keyed.withColumn("bucket", bucket).join(F.broadcast(full), ["bucket", "often"], "left").withColumn("own", F.pmod(F.xxhash64("class_id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    # a block meets each block; with itself only once
    meets = dealt.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    sig = F.when(F.col("blocks").isNull(), F.col("sig")).otherwise(F.xxhash64("sig", low, high))
    side = meets.select(sig.alias("sig"), "class_id", "size", "at", F.when(low == high, -1).otherwise(F.col("own")).alias("own"))
    x, y = side.toDF("sig", "a", "sa", "ja", "oa"), side.toDF("sig", "b", "sb", "jb", "ob")
    most = 1 + F.least(F.col("sa") - F.col("ja"), F.col("sb") - F.col("jb"))
    fits = (F.col("a") < F.col("b")) & (F.least("sa", "sb") * den >= F.greatest("sa", "sb") * num) & (most * (num + den) >= (F.col("sa") + F.col("sb")) * num)
    # merged, as the optimizer doesn't see how many signatures a small table gives
    candidates = x.join(y.hint("merge"), "sig").filter(fits & ((F.col("oa") != F.col("ob")) | (F.col("oa") == -1))).select("a", "b").distinct()
    content = classes.select("class_id", "content")
    both = candidates.join(content.toDF("a", "ca"), "a").join(content.toDF("b", "cb"), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("ca", "cb")).alias("_i"), (F.size("ca") + F.size("cb")).alias("_n"))
    return shared.filter(F.col("_i") * (num + den) >= F.col("_n") * num).select("a", "b", (F.col("_i") / (F.col("_n") - F.col("_i"))).alias("similarity"))


def _grid(classes: DataFrame, radius: float) -> tuple[list[int], float]:
    """The places and the width of the cells of vector_links, from one count of values by place and bin over all rows.

    Of widths of 2, 4, 8 ... radii and of places from the most to the least spread out, those for which the cells a
    vector is looked for in and the vectors found there are fewest, as if places were independent.
    """
    step = 2 * radius
    bins = classes.select(F.posexplode("content").alias("k", "x")).groupBy("k", F.floor(F.col("x") / step).alias("bin")).agg(F.count("*").alias("n"))
    counts: dict[int, Counter] = {}
    for k, b, n in bins.collect():  # at most places * (range / step) rows
        counts.setdefault(k, Counter())[b] += n
    if not counts:
        return [0], step
    rows = sum(counts[0].values())
    best = (float("inf"), [0], step)
    for times in (1, 2, 4, 8, 16):
        alike = []
        for k, c in counts.items():
            wide: Counter = Counter()
            for b, n in c.items():
                wide[b // times] += n
            alike.append((sum((n / rows) ** 2 for n in wide.values()), k))
        alike.sort()
        reach = 1 + 1 / times
        cells, found = 1.0, float(rows)
        for used, (share, _) in enumerate(alike, 1):
            cells *= reach
            found *= share * reach
            best = min(best, (4 * cells + found, [k for _, k in alike[:used]], step * times))
    return best[1], best[2]


def vector_links(classes: DataFrame, radius: float = 0.01, block: int = BLOCK) -> DataFrame:
    """a, b (a < b), similarity: all pairs of classes whose vectors (content ARRAY<DOUBLE>) differ by at most radius in every place.

    Exact. Cells over the places and of the width that _grid finds for these rows, so that cells stay small as rows
    grow; a vector is looked for in its own cell and in the neighbours its radius reaches. Cells of more than `block`
    vectors are dealt into blocks, of which the one asked meets each. similarity = 1 - greatest difference.
    """
    places, width = _grid(classes, radius)
    reach = radius * (1 + 1e-9)
    cell = lambda c, by: f"bigint(floor(({c} + {by!r}D) / {width!r}D))"
    own = classes.select(F.col("class_id").alias("b"), F.col("content").alias("cb"), F.xxhash64(*[F.expr(cell(f"content[{k}]", 0.0)) for k in places]).alias("cell"))
    asked = classes.select(F.col("class_id").alias("a"), F.col("content").alias("ca"))
    for k in places:
        asked = asked.withColumn(f"_c{k}", F.explode(F.expr(f"sequence({cell(f'ca[{k}]', -reach)}, {cell(f'ca[{k}]', reach)})")))
    asked = asked.select("a", "ca", F.xxhash64(*[F.col(f"_c{k}") for k in places]).alias("cell"))
    bucket = F.pmod("cell", F.lit(_BUCKETS)).cast("int")
    full = own.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).filter(F.col("n") > block).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    deal = lambda rows: rows.withColumn("bucket", bucket).join(F.broadcast(full), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = deal(own).select("cell", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("part"), "b", "cb")
    asked = deal(asked).select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "a", "ca")
    gap = F.expr("aggregate(zip_with(ca, cb, (x, y) -> abs(x - y)), 0D, (m, x) -> greatest(m, x))")
    # distinct, as two cells of one vector may share a hash
    return asked.join(own.hint("merge"), ["cell", "part"]).filter("a < b").withColumn("_g", gap).filter(F.col("_g") <= radius).select("a", "b", (1 - F.col("_g")).alias("similarity")).distinct()


def pivot_clusters(vertices: DataFrame, links: DataFrame, seed: int = 7) -> DataFrame:
    """class_id, pivot: every vertex (class_id) with the pivot of its cluster, by parallel pivot correlation clustering.

    Priorities are hashes of the ids. In each round every active vertex whose priority is least among its active
    neighbours becomes a pivot and absorbs them, a neighbour of several going to the one of least priority; what is
    absorbed is no longer active. Rounds go on until no link joins two active vertices (about log n of them); the rest
    are clusters of one. Then each member moves to the most similar pivot it has a link with. links (a, b, similarity)
    names each pair once. Every round is written to the shared folder; the one before is deleted then.
    """
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)), F.col(c))
    two = links.select("a", "b", "similarity").union(links.select("b", "a", "similarity")).toDF("v", "u", "similarity")
    active, pivots, before = two.select("v", "u"), None, None
    while True:
        # a vertex sees the least of its active neighbours; pivots are those before all their neighbours
        new = cut(active.groupBy("v").agg(F.min(rank("u")).alias("_m")).filter(rank("v") < F.col("_m")).select("v"), "new")
        if new.isEmpty():
            drop(new)
            break
        pivots = new if pivots is None else pivots.union(new)
        gone = active.join(new.select(F.col("v").alias("u")), "u", "left_semi").select("v").union(new).distinct()
        rest = cut(active.join(gone, "v", "left_anti").join(gone.select(F.col("v").alias("u")), "u", "left_anti").select("v", "u"), "active")
        if before is not None:
            drop(before)
        active = before = rest
    if before is not None:
        drop(before)
    if pivots is None:
        return vertices.select("class_id", F.col("class_id").alias("pivot"))
    near = two.join(pivots.select(F.col("v").alias("u")), "u", "left_semi").join(pivots, "v", "left_anti")
    moved = near.groupBy("v").agg(F.max(F.struct("similarity", -F.col("u"))).alias("_b")).select(F.col("v").alias("class_id"), (-F.col("_b.col2")).alias("pivot"))
    return vertices.select("class_id").join(moved, "class_id", "left").select("class_id", F.coalesce("pivot", "class_id").alias("pivot"))


def medoids(classes: DataFrame, clusters: DataFrame, links: DataFrame) -> DataFrame:
    """class_id, pivot, members, size, closeness: each class with its mean similarity to the records of its cluster.

    Records without a link count as similarity 0, copies as 1. size is the number of records of the cluster.
    """
    own = classes.select("class_id", "members").join(clusters, "class_id")
    side = own.select("class_id", "pivot", "members")
    two = links.select("a", "b", "similarity").union(links.select("b", "a", "similarity")).toDF("v", "u", "similarity")
    inside = two.join(side.toDF("v", "pv", "mv"), "v").join(side.toDF("u", "pu", "mu"), "u").filter("pv = pu")
    sums = inside.groupBy(F.col("v").alias("class_id")).agg(F.sum(F.col("similarity") * F.col("mu")).alias("_s"))
    sizes = own.groupBy("pivot").agg(F.sum("members").alias("size"))
    close = (F.coalesce("_s", F.lit(0.0)) + F.col("members")) / F.col("size")
    return own.join(sums, "class_id", "left").join(sizes, "pivot").select("class_id", "pivot", "members", "size", close.alias("closeness"))


def typical_members(scored: DataFrame, k: int = 5) -> DataFrame:
    """pivot, class_id, place: the k classes of each cluster (as of medoids) of the greatest closeness, ties: the lesser id.

    place 1 is the medoid. Tasks keep k rows of a cluster before anything is shuffled.
    """
    by = Window.partitionBy("pivot").orderBy(F.desc(F.round("closeness", 12)), "class_id")
    return scored.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k).select("pivot", "class_id", "place")


def split_by_pivots(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """a, b, apart: the links with whether the pivots put their ends into different clusters."""
    side = clusters.select("class_id", "pivot")
    return links.join(side.toDF("a", "_pa"), "a").join(side.toDF("b", "_pb"), "b").select("a", "b", (F.col("_pa") != F.col("_pb")).alias("apart"))


def member_pairs(records: DataFrame, classes: DataFrame, clusters: DataFrame, links: DataFrame, copies_in_full: int = 1000) -> DataFrame:
    """id_a, id_b (id_a < id_b): the pairs of records of one cluster that are linked or equal, as by linked_pairs."""
    return linked_pairs(records, classes, split_by_pivots(links, clusters), copies_in_full).filter("NOT apart").select("id_a", "id_b")


def linked_pairs(records: DataFrame, classes: DataFrame, links: DataFrame, copies_in_full: int = 1000) -> DataFrame:
    """id_a, id_b (id_a < id_b), apart: all pairs of records that are linked (a, b, apart) or equal (apart is false).

    records has record_id and content. A class of more than copies_in_full equal records is given by pairs of its
    least id with each other member, and stands for its members in pairs with other classes; no pair of different
    contents is lost, as equal records have the same partners.
    """
    many = classes.filter("members > 1").select("content", "class_id", "members")
    member = cut(records.join(many, "content").select("class_id", "members", "record_id"), "copies")
    spread = member.filter(F.col("members") <= copies_in_full).select("class_id", "record_id")
    a = links.join(spread.toDF("a", "ra"), "a", "left").select(F.coalesce("ra", "a").alias("x"), "b", "apart")
    ab = a.join(spread.toDF("b", "rb"), "b", "left").select("x", F.coalesce("rb", "b").alias("y"), "apart")
    equal = member.select("class_id", F.col("record_id").alias("x"), "members").join(spread.toDF("class_id", "y"), "class_id").filter("x < y").select("x", "y", F.lit(False))
    star = member.filter((F.col("members") > copies_in_full) & (F.col("record_id") > F.col("class_id"))).select(F.col("class_id").alias("x"), F.col("record_id").alias("y"), F.lit(False))
    return ab.union(equal).union(star).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "apart")
