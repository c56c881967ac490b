"""Verified links between sets of shingles: candidates by band, star rounds, and an exact
prefix-filter join of what those leave unconnected.

Sets are told apart by a digest. Candidates agree in a band; their odd sketches must not be
further apart than similar sets' can be; links are confirmed on the full sets. Of a band only
its first set (the one that shares most bands) is compared to the others (a star), first one star a set, then, where that connects them not
yet, every band's. Where the others are of several components still, a few more rounds compare another
set of the band's largest component to those outside of it. Sets of bands that hold more than one component after that are joined exactly: tokens
are ordered by rarity among these sets, and two sets as similar as asked share one of their rarest tokens
(a prefix of n - ceil(least n) + 1), at positions that still leave enough to share, and their parities (a bit for
each 512th of all tokens) differ in no more bits than so similar sets have tokens of their own. Tokens that one
component has alone are left out, and within a token the largest component is paired with the others
only, so a group of near copies is never paired with itself. A token of many sets is dealt in parts.

What is linked may leave out links within a component: connected sets stay connected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.common import cut, dealt_join
from bundlelens.llm.components import components

#: Pairs of one set that a task verifies, about; the set is copied for every further part.
PART = 128
#: Sets of one token that a task has, about.
TOKEN_PART = 2048
#: Bands that several sets share are broadcast up to this number (8 bytes each), joined by a shuffle above it.
BROADCAST_BANDS = 1_000_000


def verified(pairs: DataFrame, sets: DataFrame, percent: int, part: int = PART) -> DataFrame:
    """The pairs(da, db) whose sets(digest, hashes) have 100 |A and B| >= percent |A or B|.

    The first set of a large group is da of all its pairs: they are dealt in parts by db, each with
    a copy of that set, so no task has the whole group.
    """
    pairs = cut(pairs, "candidates")
    own = sets.join(pairs.select(F.col("da").alias("digest")).union(pairs.select("db")).distinct(), "digest", "left_semi")
    hot = cut(pairs.groupBy("da").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1"), "hot_sets")
    dealt = pairs.join(hot, "da", "left").withColumn("part", F.pmod(F.xxhash64("db"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    sa = own.select(F.col("digest").alias("da"), F.col("hashes").alias("ha")).join(hot, "da", "left")
    sa = sa.select("da", "ha", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    sb = own.select(F.col("digest").alias("db"), F.col("hashes").alias("hb"))
    both = dealt.join(sa, ["da", "part"]).join(sb, "db").withColumn("common", F.size(F.array_intersect("ha", "hb")))
    return cut(both.where(100 * F.col("common") >= percent * (F.size("ha") + F.size("hb") - F.col("common"))).select("da", "db"), "similar")


def apart(a: Column, b: Column, longs: int) -> Column:
    """Bits in which two odd sketches differ."""
    out = F.bit_count(a[0].bitwiseXOR(b[0]))
    for k in range(1, longs):
        out = out + F.bit_count(a[k].bitwiseXOR(b[k]))
    return out


def near_enough(percent: int, a: str, b: str, longs: int) -> Column:
    """False where the parities of two whole sets tell that they can't be as similar: each token that one
    set has alone flips one bit at most, so the differing bits (of n_ and parity_ a and b) never exceed those tokens."""
    n, m = F.col(f"n_{a}"), F.col(f"n_{b}")
    alike = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return alike & (apart(F.col(f"parity_{a}"), F.col(f"parity_{b}"), longs) * (100 + percent) <= (n + m) * (100 - percent))


def prefix_pairs(sets: DataFrame, percent: int, longs: int, part: int = TOKEN_PART) -> DataFrame:
    """Of sets(digest, c, hashes, parity), all pairs (da, db) of different c that can have that similarity."""
    tokens = cut(sets.select("digest", "c", "parity", F.size("hashes").alias("n"), F.explode("hashes").alias("token")), "tokens")
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")  # others are rarer still, and join nothing
    ranked = tokens.join(common, "token").groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order"), F.first("c").alias("c"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    alone = F.col("n") - F.size("order")
    length = F.col("n") - F.expr(f"(n * {percent} + 99) div 100").cast("int") + 1
    prefix = ranked.withColumn("head", F.slice("order", F.lit(1), F.greatest(length - alone, F.lit(0))))
    entries = prefix.select("digest", "c", "n", "parity", alone.alias("alone"), F.posexplode("head").alias("at", "t")).select("digest", "c", "n", "parity", (F.col("alone") + F.col("at")).alias("at"), F.col("t.token").alias("token"))
    entries = cut(entries, "prefixes")
    sizes = entries.groupBy("token", "c").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("c", F.struct("m", "c")).alias("largest"), F.sum("m").alias("all"), F.count("*").alias("groups")).where("groups > 1")
    met = entries.join(sizes.withColumn("parts", F.ceil(F.col("all") / part).cast("int")), "token")
    rest = met.where("c <> largest").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a = rest.select("token", "part", *[F.col(x).alias(f"{x}_a") for x in ("digest", "c", "n", "at", "parity")])
    b = met.select("token", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part"), "largest", *[F.col(x).alias(f"{x}_b") for x in ("digest", "c", "n", "at", "parity")])
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # of the first token they share, both have no more
    fits = near_enough(percent, "a", "b", longs) & ((100 + percent) * left >= percent * (F.col("n_a") + F.col("n_b")))
    once = (F.col("c_b") == F.col("largest")) | (F.col("digest_a") < F.col("digest_b"))
    pairs = a.join(b, ["token", "part"]).where((F.col("c_a") != F.col("c_b")) & once & fits)
    return pairs.select(F.least("digest_a", "digest_b").alias("da"), F.greatest("digest_a", "digest_b").alias("db")).distinct()


def linked_sets(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, cutoff: int, longs: int, parity_longs: int, rounds: int = 2) -> DataFrame:
    """Links (da, db) that connect all similar sets of nodes(digest, n, odd, parity, bands) that share a band.

    sets: gives (digest, hashes) of the digests asked for; cutoff: the most bits in which the odd
    sketches of similar sets may differ; longs, parity_longs: the lengths of a sketch and of a set's parity; rounds: star
    rounds of other sets than the first of each band. The first set of a band is the one that shares most bands with others.
    """
    bare = nodes.select("digest", F.explode("bands").alias("e"))
    shared = cut(bare.groupBy("e").agg(F.count("*").alias("sets")).where("sets > 1"), "shared")
    met = bare.join(F.broadcast(shared) if shared.count() <= BROADCAST_BANDS else shared, "e")
    banded = cut(met, "banded")
    mass = cut(banded.groupBy("digest").agg(F.sum("sets").alias("mass")), "mass")
    banded = cut(banded.drop("sets").join(mass, "digest"), "massed")
    sets = cut(sets(mass.select("digest")), "sets")
    told = cut(nodes.select("digest", "n", "odd", "parity").join(mass.select("digest"), "digest", "left_semi"), "told")

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs(da, db) that are links; many may have the same da."""
        a, b = (told.select(F.col("digest").alias(f"d{x}"), *[F.col(k).alias(f"{k}_{x}") for k in ("n", "odd", "parity")]) for x in "ab")
        both = dealt_join(pairs.distinct().join(b, "db"), a, "da", ["db"])
        near = (apart(F.col("odd_a"), F.col("odd_b"), longs) <= cutoff) & near_enough(percent, "a", "b", parity_longs)
        return verified(both.where(near).select("da", "db"), sets, percent)

    def connected(links: DataFrame) -> DataFrame:
        """banded with the component of each set."""
        linked = components(links.toDF("a", "b")).select(F.col("node").alias("digest"), F.col("component").alias("c"))
        return cut(banded.join(linked, "digest", "left").withColumn("c", F.coalesce("c", "digest")), "connected")

    hubs = cut(banded.groupBy("e").agg(F.max(F.struct("mass", "digest")).alias("hub")), "hubs")
    starred = banded.join(hubs, "e").where(F.col("digest") != F.col("hub.digest"))
    links = checked(starred.groupBy("digest").agg(F.max("hub").alias("hub")).select(F.col("hub.digest").alias("da"), F.col("digest").alias("db")))
    hubs = hubs.select("e", F.col("hub.digest").alias("hub"))
    rows = connected(links)
    of_hubs = rows.join(hubs.withColumnRenamed("hub", "digest"), ["e", "digest"]).select("e", F.col("digest").alias("hub"), F.col("c").alias("hub_c"))
    links = links.unionByName(checked(rows.join(of_hubs, "e").where("c <> hub_c").select(F.col("hub").alias("da"), F.col("digest").alias("db"))))
    # a band's first set has met all others of another component: what is left is between the others
    rows = connected(links).join(hubs, "e").where("digest <> hub").drop("hub")
    for k in range(rounds + 1):
        order = F.col("mass") if k == 0 else F.xxhash64("digest", F.lit(k))
        largest = rows.groupBy("e", "c").agg(F.count("*").alias("m"), F.max(F.struct(order.alias("order"), "digest")).alias("some"))
        largest = largest.groupBy("e").agg(F.max(F.struct("m", "c", "some")).alias("top"), F.count("*").alias("components")).where("components > 1")
        left = cut(rows.join(largest.select("e", F.col("top.c").alias("top_c"), F.col("top.some.digest").alias("hub")), "e"), "unconnected")
        if k == rounds or left.isEmpty():
            break
        links = links.unionByName(checked(left.where("c <> top_c").select(F.col("hub").alias("da"), F.col("digest").alias("db"))))
        rows = connected(links).join(left.select("e", "digest"), ["e", "digest"], "left_semi")
    parity = told.select("digest", "parity")
    return links.unionByName(checked(prefix_pairs(left.select("digest", "c").distinct().join(sets, "digest").join(parity, "digest"), percent, parity_longs)))
