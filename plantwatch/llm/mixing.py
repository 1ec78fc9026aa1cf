"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations.

The tree has the levels domain, language and source; a node's share of its parent is its weight over the weights of its
siblings. A leaf can give its tokens ``max_epochs`` times, a node what its leaves can give. From the root down each budget is
dealt to the children by weight, and what a child can't use goes to its siblings by weight; only what all siblings can't
use is missing one level up, where it was dealt to others in the same way. So shortages stay among siblings as long as
they can. Inside a leaf every epoch has its own seeded order; whole epochs are taken first, then the token prefix of the next.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from plantwatch.llm.store import written

SEED = 11
MAX_EPOCHS = 4
#: An epoch's order is cut into so many stretches; rows are put in order in the one stretch where the prefix ends.
STRETCHES = 4096
#: Weight of a value by level; a value that isn't named has ``OTHER``.
WEIGHTS = {"domain": {"d0": 40, "d1": 30, "d2": 20, "d3": 10}, "language": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {}}
OTHER = 10
LEVELS = ("domain", "language", "source")
_NONE = "(none)"


def domain_of(source):
    """The default domains: sources in four groups by the number in their name; without one, the group of none."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (F.right(number, F.lit(6)).cast("int") % 4).cast("string")))


def token_count(text):
    """Words between spaces, tabs and line ends."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \t\n\r]+")).cast("bigint")


def _weight(level, weights, other):
    named = weights.get(level) or {}
    if any(w < 0 or w != int(w) for w in [*named.values(), other]):
        raise ValueError("weights are whole numbers of at least 0")
    return reduce(lambda c, kv: c.when(F.col(level) == kv[0], kv[1]), named.items(), F.when(F.lit(False), 0)).otherwise(other).cast("bigint")


def _whole(column):
    return column.cast("decimal(38,0)")


def dealt(nodes, parents, path):
    """Deal the parents' budgets to the nodes: columns ``path``, ``can``, ``weight`` and the parents' ``budget``.

    Sorted by capacity for a weight, a node is full if its capacity is at most its share of what the fuller ones before
    it left. All others share the rest by weight, rounded down.
    """
    above = list(path[:-1])
    siblings = nodes.withColumn("root", F.lit(0)).join(parents.withColumn("root", F.lit(0)), ["root", *above])
    among = Window.partitionBy("root", *above)
    ordered = among.orderBy(F.col("can") / F.col("weight"), path[-1])
    siblings = siblings.filter("weight > 0").withColumns({
        "before": F.sum("can").over(ordered.rowsBetween(Window.unboundedPreceding, -1)),
        "weight_left": F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))})
    siblings = siblings.withColumn("before", F.coalesce("before", F.lit(0)))
    full = _whole(F.col("can")) * _whole(F.col("weight_left")) <= _whole(F.col("budget") - F.col("before")) * _whole(F.col("weight"))
    siblings = siblings.withColumn("is_full", full).withColumns({
        "used": F.sum(F.when(F.col("is_full"), F.col("can")).otherwise(0)).over(among),
        "sharing": F.sum(F.when(F.col("is_full"), 0).otherwise(F.col("weight"))).over(among)})
    share = F.expr("cast(cast(budget - used as decimal(38,0)) * cast(weight as decimal(18,0)) div sharing as bigint)")
    return siblings.select(*path, F.when(F.col("is_full"), F.col("can")).otherwise(share).alias("budget"))


def leaf_budgets(leaves, total, levels=LEVELS, weights=WEIGHTS, other=OTHER):
    """Tokens that each leaf shall give; ``leaves`` has the levels and ``can``, ``total`` is a one-row table ``budget``."""
    budget = total
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        nodes = leaves.groupBy(*path).agg(F.sum("can").alias("can")).withColumn("weight", _weight(path[-1], weights, other))
        budget = dealt(nodes, budget, path)
    return budget


def mixed(docs, total=None, share=1.0, max_epochs=MAX_EPOCHS, weights=WEIGHTS, other=OTHER, seed=SEED, domain=None, stretches=STRETCHES,
          id_column="doc_id", text_column="text", language_column="lang", source_column="source"):
    """The mixture: a row for each document and epoch in which it is taken.

    Columns: ``doc_id``, ``domain``, ``language``, ``source``, ``epoch`` (from 1), ``n_tokens`` (words) and ``taken``, the
    tokens of it that count; the last document of a prefix may be taken in part. The budget is ``total`` tokens, or
    ``share`` times the corpus's. Weights are whole numbers; a weight of 0 leaves a branch out. A leaf whose tokens
    suffice gives a prefix of the first epoch; if no leaf can give more, the mixture is smaller than the budget.

    Null and empty texts have no tokens; they are taken where their place in the order lies before a prefix's end, and in
    whole epochs. A null language, source or domain is the value "(none)". Documents are ordered by a seeded hash of id and epoch,
    then by id and tokens; repeated rows count as often as they occur. Other columns are left out, whatever their names;
    an empty table gives an empty result. Of very long texts only the number of words counts; a text is never cut.
    """
    levels = LEVELS
    domain = domain_of(F.col(source_column)) if domain is None else domain
    named = {"domain": domain, "language": F.col(language_column), "source": F.col(source_column)}
    base = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), *[F.coalesce(named[k].cast("string"), F.lit(_NONE)).alias(k) for k in levels],
                       token_count(F.col(text_column)).alias("n_tokens"))
    base = written(base, "mix-rows", docs.sparkSession)
    sums = base.groupBy(*levels).agg(F.sum("n_tokens").alias("own"))
    leaves = written(sums.withColumn("can", F.col("own") * max_epochs), "mix-leaves", docs.sparkSession)
    corpus = leaves.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("own"))
    budget = corpus.select((F.lit(total) if total is not None else F.floor(F.col("own") * F.lit(float(share)))).cast("bigint").alias("budget"))
    plan = leaf_budgets(leaves, budget, levels, weights, other).join(leaves, list(levels)).filter("own > 0")
    plan = written(plan.select(*levels, F.expr("cast(budget div own as int)").alias("whole"), F.expr("budget % own").alias("prefix")), "mix-plan", docs.sparkSession)

    rows = base.join(plan, list(levels)).withColumn("part", F.col("whole") + 1)
    key = F.concat_ws(":", F.lit(str(seed)), F.col("part").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("order", F.md5(key.cast("binary")))
    rows = rows.withColumn("stretch", F.floor(F.conv(F.left("order", F.lit(6)), 16, 10).cast("bigint") * stretches / F.lit(1 << 24)).cast("int"))
    run = Window.partitionBy(*levels).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.filter("prefix > 0").groupBy(*levels, "stretch").agg(F.sum("n_tokens").alias("size"))
    parts = parts.withColumn("start", F.coalesce(F.sum("size").over(run), F.lit(0)))
    rows = rows.join(parts, [*levels, "stretch"], "left")
    cut = F.col("start") + F.col("size") > F.col("prefix")
    inside = Window.partitionBy(*levels, "stretch").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.filter((F.col("start") < F.col("prefix")) & ~cut).withColumn("taken", F.col("n_tokens"))
    last = rows.filter((F.col("start") < F.col("prefix")) & cut)
    last = last.withColumn("place", F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    last = last.filter("place < prefix").withColumn("taken", F.least("n_tokens", F.col("prefix") - F.col("place"))).drop("place")
    partial = ahead.unionByName(last).withColumn("epoch", F.col("part"))
    whole = base.join(plan, list(levels)).filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("whole")))).withColumn("taken", F.col("n_tokens"))
    out = ["doc_id", *levels, "epoch", "n_tokens", "taken"]
    return whole.select(*out).unionByName(partial.select(*out))


def chosen(docs, **settings):
    """The rows of the documents that a mixture of one epoch takes in whole or in part, with their own columns.

    Rows that repeat an id stay together if one of them is taken.
    """
    taken = mixed(docs, max_epochs=1, **settings).select(F.col("doc_id").alias("_taken")).distinct()
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["_taken"]), "left_semi")


def _cases(level):
    return "CASE " + " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in WEIGHTS[level].items()) + f" ELSE {OTHER} END" if WEIGHTS[level] else str(OTHER)


def _level_sql(name, before, path):
    """SQL of one level: the budgets of the nodes at ``path``."""
    columns, parent = ", ".join(path), ", ".join(path[:-1])
    among = f"PARTITION BY {parent}" if parent else ""
    using = f"JOIN {before} USING ({parent})" if parent else f"CROSS JOIN {before}"
    return f"""
{name}_n AS (SELECT {columns}, sum(can)::BIGINT AS can, ({_cases(path[-1])})::BIGINT AS weight FROM leaves GROUP BY {columns}),
{name}_o AS (SELECT n.*, budget, coalesce(sum(can) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
   sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS weight_left
   FROM {name}_n n {using} WHERE weight > 0 WINDOW o AS ({among} ORDER BY can / weight, {path[-1]})),
{name}_f AS (SELECT *, can::HUGEINT * weight_left <= (budget - before) * weight AS is_full FROM {name}_o),
{name}_u AS (SELECT *, sum(CASE WHEN is_full THEN can ELSE 0 END) OVER ({among}) AS used,
   sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({among}) AS sharing FROM {name}_f),
{name} AS (SELECT {columns}, (CASE WHEN is_full THEN can ELSE ((budget - used)::HUGEINT * weight) // sharing END)::BIGINT AS budget FROM {name}_u)"""


#: The mixture with the default settings.
SQL = f"""
WITH base AS (SELECT doc_id, coalesce(CASE WHEN regexp_extract(source, '([0-9]+)$', 1) <> ''
     THEN 'd' || (right(regexp_extract(source, '([0-9]+)$', 1), 6)::INT % 4)::VARCHAR END, '{_NONE}') AS domain,
   coalesce(lang, '{_NONE}') AS language, coalesce(source, '{_NONE}') AS source,
   len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, language, source, sum(n_tokens)::BIGINT AS own, (sum(n_tokens) * {MAX_EPOCHS})::BIGINT AS can FROM base GROUP BY ALL),
corpus AS (SELECT coalesce(sum(own), 0)::BIGINT AS budget FROM leaves),
{_level_sql("l1", "corpus", LEVELS[:1])},{_level_sql("l2", "l1", LEVELS[:2])},{_level_sql("l3", "l2", LEVELS)},
plan AS (SELECT domain, language, source, (budget // own)::INT AS whole, budget % own AS prefix FROM l3 JOIN leaves USING (domain, language, source) WHERE own > 0),
ordered AS (SELECT b.*, whole, prefix, coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, source
   ORDER BY md5('{SEED}:' || (whole + 1) || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
   FROM base b JOIN plan USING (domain, language, source))
SELECT doc_id, domain, language, source, unnest(range(1, whole + 1))::INT AS epoch, n_tokens, n_tokens AS taken FROM ordered
UNION ALL
SELECT doc_id, domain, language, source, (whole + 1)::INT AS epoch, n_tokens, least(n_tokens, prefix - place)::BIGINT AS taken FROM ordered WHERE place < prefix
""".strip()
