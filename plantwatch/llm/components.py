"""Connected components of a table of links, by alternating large stars and small stars.

Each round replaces links by links to smaller neighbours; the links become stars after about log(longest path) rounds.
A round is written to the shared folder, so nothing of the graph passes the driver and a lost executor costs no old round.
"""

from pyspark.sql import functions as F

from plantwatch.llm.store import written


def components(links, a="a", b="b"):
    """``node`` and ``root`` (the least node of its component) of every node that has a link to another.

    Repeated links, links in both directions and links of a node to itself change nothing; null ends are left out.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    stars, mark = written(pairs.distinct(), "links"), None
    while True:
        both = stars.union(stars.select("v", "u"))
        # stored, so that the join shuffles both of its sides and Spark can split a node with very many links
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least-neighbours")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if now == mark:
            break
        mark = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
