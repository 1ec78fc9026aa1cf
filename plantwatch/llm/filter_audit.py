"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

A document has a mask of the filters that it fails. Per part (language) the masks are counted, and the counts become a
decision diagram: a level for each filter, a branch for pass and one for fail, equal branches shared, and at every node how
many documents (all, good, toxic) lie below. In a diagram whose levels stand in the order of a chain, the path of passes
tells the chain's steps: the fail branch at a level holds what the step removes, the pass branch what it keeps. One diagram
gives all orders: the next order swaps two neighbouring filters, which changes only the nodes of these two levels.
"""

import math
from itertools import permutations

import pyarrow as pa
from pyspark.sql import functions as F

from plantwatch.llm.store import written

FILTERS = "ABCDE"
#: Words of the audit, and the filters' limits.
WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT, MARKS = 200, 50, 3, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEP = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class Diagram:
    """A decision diagram of counted failure masks, with levels that can be reordered.

    ``counts`` maps a mask (bit k: filter k fails) to a tuple of counts. A node is a list of its pass branch, its fail branch
    and the sum of both; below the last level stand tuples of counts. No level is left out, so weights need no factors.
    ``levels`` holds the nodes of each level by their branches, so that equal ones are one.
    """

    def __init__(self, counts, variables):
        self.order = list(range(variables))
        self.levels = [{} for _ in range(variables)]
        self.none = (0,) * len(next(iter(counts.values()), (0,)))
        self.root = self._built(counts, 0)

    def _built(self, counts, level):
        if level == len(self.order):
            return sum_of(counts.values(), self.none)
        bit = 1 << self.order[level]
        passes = {m: c for m, c in counts.items() if not m & bit}
        fails = {m: c for m, c in counts.items() if m & bit}
        return self._node(level, self._built(passes, level + 1), self._built(fails, level + 1))

    def _key(self, level, passes, fails):
        return (passes, fails) if level + 1 == len(self.order) else (id(passes), id(fails))

    def _node(self, level, passes, fails):
        """The one node of a level with these branches."""
        key = self._key(level, passes, fails)
        if key not in self.levels[level]:
            below = level + 1
            self.levels[level][key] = [passes, fails, sum_of((self.weight(passes, below), self.weight(fails, below)), self.none)]
        return self.levels[level][key]

    def weight(self, node, level):
        return node if level == len(self.order) else node[2]

    def swap(self, level):
        """Exchange the filters of ``level`` and the next one: nodes above and below stay, and so do the upper nodes' sums."""
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        upper, self.levels[level], self.levels[level + 1] = list(self.levels[level].values()), {}, {}
        old = [list(node) for node in upper]  # keeps the lower nodes alive while their branches are dealt anew
        for node in upper:
            (pass_pass, pass_fail, _), (fail_pass, fail_fail, _), _ = node
            node[0], node[1] = self._node(level + 1, pass_pass, fail_pass), self._node(level + 1, pass_fail, fail_fail)
            self.levels[level][self._key(level, node[0], node[1])] = node
        del old

    def steps(self):
        """Along the path of passes: the filter of each level, what it removes and what it keeps."""
        node = self.root
        for level, variable in enumerate(self.order):
            yield variable, self.weight(node[1], level + 1), self.weight(node[0], level + 1)
            node = node[0]


def sum_of(counts, none):
    return tuple(map(sum, zip(none, *counts)))


def neighbour_swaps(n):
    """Levels to swap, one after the other, so that all orders of ``n`` filters come up once (plain changes)."""
    if n < 2:
        return
    inner = list(neighbour_swaps(n - 1))
    for k in range(math.factorial(n - 1)):
        # the last filter moves through all places, down and up in turn
        yield from (range(n - 2, -1, -1) if k % 2 == 0 else range(n - 1))
        if k < len(inner):
            yield inner[k] + (k % 2 == 0)


def audit_of_part(counts, filters=FILTERS):
    """Steps of all orders of one part, from its counted masks: rows of ``STEP`` without the part."""
    diagram = Diagram(counts, len(filters))
    total = diagram.root[2][0] if filters else 0
    fails = [sum(c[0] for m, c in counts.items() if m >> k & 1) for k in range(len(filters))]
    alone = [counts.get(1 << k, (0,))[0] for k in range(len(filters))]
    shapley, found = [0] * len(filters), []

    def read():
        name = "".join(filters[v] for v in diagram.order)
        left = total
        for step, (v, removed, kept) in enumerate(diagram.steps(), 1):
            assert kept[0] + removed[0] == left
            left = kept[0]
            shapley[v] += removed[0]
            found.append((name, step, v, kept[0], removed[0], fails[v] - removed[0], alone[v], removed[1], removed[2]))

    read()
    for level in neighbour_swaps(len(filters)):
        diagram.swap(level)
        read()
    return [(name, step, *numbers, shapley[v]) for name, step, v, *numbers in found]


def text_failures(text, words):
    """The failures that a text alone decides (A to D), as a mask column; ``words`` is the array of its words."""
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    length = F.length(text).cast("long")
    capitals = length - F.length(F.translate(text, CAPITALS, ""))
    checks = [n < MIN_WORDS, distinct * 100 < n * MIN_DISTINCT_PCT, capitals * 100 > length * MAX_CAPITALS_PCT, text.rlike(MARKS)]
    return sum((F.when(check, 1 << k).otherwise(0) for k, check in enumerate(checks)), F.lit(0))


def failure_masks(docs, id_column="doc_id", text_column="text", part_column="lang"):
    """``part``, ``doc_id``, ``mask`` and ``n``: rows of ``docs`` by part, id and mask of the filters that they fail.

    Whether a text is a copy (E) needs the least id of each text: texts are known by their SHA-256, rows are counted by text
    and id, and the least ids are found by text and id again, so a text that a third of the rows share is spread by its ids.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), F.col(id_column).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("key"), text_failures(F.col("text"), F.col("words")).alias("mask"))
    # nulls come after all ids
    rows = rows.select("part", "key", "mask", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"))
    rows = written(rows.groupBy("key", "no_id", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "audit-rows")
    least = rows.groupBy("key").agg(F.min(F.struct("no_id", "doc_id")).alias("least")).select("key", "least.*", F.lit(True).alias("is_least"))
    rows = rows.join(least, ["key", "no_id", "doc_id"], "left")
    copy = F.when(F.col("is_least"), 0).otherwise(1 << FILTERS.index("E"))
    return rows.select("part", F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), (F.col("mask") + copy).alias("mask"), "n")


def mask_counts(masks, labels, id_column="doc_id"):
    """Per part and mask: ``n`` documents, ``good`` and ``toxic`` ones by the labels."""
    marks = labels.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("doc_id"))
    marks = marks.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    masks = written(masks, "audit-masks")
    marked = masks.join(marks.filter("good + toxic > 0"), "doc_id").groupBy("part", "mask")
    marked = marked.agg(F.lit(0).cast("long").alias("n"), F.sum(F.col("good") * F.col("n")).alias("good"), F.sum(F.col("toxic") * F.col("n")).alias("toxic"))
    zero = F.lit(0).cast("long")
    plain = masks.groupBy("part", "mask").agg(F.sum("n").alias("n"), zero.alias("good"), zero.alias("toxic"))
    return plain.union(marked).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def filter_audit(docs, labels, id_column="doc_id", text_column="text", part_column="lang"):
    """Every step of every order of the five filters, in every part: columns of ``STEP``.

    A document fails A with under 200 words, B if fewer than half of its words are distinct, C if over 3 % of its code points
    are A to Z, D if it holds one of ``#$%&*|``, E if a smaller id anywhere in the table has the same text. ``redundant`` fail
    the step's filter but were removed before, ``unique_fails`` fail no other, ``shapley`` sums what the filter removes
    over all orders.

    Null texts are empty, a null part is the empty string (one part with those that are empty), null ids come after all
    others and have no label. Repeated rows count each; rows that share id and text are no copies of one another. Of
    repeated labels the highest counts. Very long texts are taken whole, as one value of a row. Other columns are not
    read. An empty table gives no rows. One group holds a part's counted masks, at most 32.
    """
    counts = mask_counts(failure_masks(docs, id_column, text_column, part_column), labels, id_column)

    def steps(key, table):
        rows = table.to_pylist()
        found = audit_of_part({r["mask"]: (r["n"], r["good"], r["toxic"]) for r in rows})
        names = ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
        types = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.string()), *columns], names=["part", *names])

    return counts.groupBy("part").applyInArrow(steps, STEP)


def _sql():
    """The steps by their definition: the kept rows of an order's step are those that fail none of its filters so far."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    bit = "(1 << (strpos('ABCDE', {}) - 1))"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                      regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
            CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
          + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
          + CASE WHEN 100 * length(regexp_replace(texts.text, '[^A-Z]', '', 'g')) > 3 * length(texts.text) THEN 4 ELSE 0 END
          + CASE WHEN regexp_matches(texts.text, '[#$%&*|]') THEN 8 ELSE 0 END
          + CASE WHEN texts.doc_id > first_id OR (texts.doc_id IS NULL AND first_id IS NOT NULL) THEN 16 ELSE 0 END AS mask
          FROM texts JOIN firsts ON texts.text = firsts.text LEFT JOIN marks USING (doc_id)),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
orders (filter_order) AS (VALUES {orders}),
places AS (SELECT filter_order, step, {bit.format('substr(filter_order, step, 1)')} AS own,
                  list_sum([{bit.format('substr(filter_order, k, 1)')} FOR k IN range(1, step)]) AS before
           FROM orders, (SELECT unnest(range(1, 6)) AS step)),
steps AS (SELECT part, filter_order, step, own,
            coalesce(sum(n) FILTER (mask & (own | coalesce(before, 0)::INT) = 0), 0) AS kept,
            coalesce(sum(n) FILTER (mask & coalesce(before, 0)::INT = 0 AND mask & own > 0), 0) AS removed,
            coalesce(sum(n) FILTER (mask & coalesce(before, 0)::INT > 0 AND mask & own > 0), 0) AS redundant,
            coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
            coalesce(sum(good) FILTER (mask & coalesce(before, 0)::INT = 0 AND mask & own > 0), 0) AS good_lost,
            coalesce(sum(toxic) FILTER (mask & coalesce(before, 0)::INT = 0 AND mask & own > 0), 0) AS toxic_lost
          FROM counted, places GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM steps"""


SQL = _sql()
