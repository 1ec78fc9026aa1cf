"""Fingerprints of documents: a Merkle tree over leaves, paragraphs and sections, in SQL functions.

A paragraph is a line; its leaves are runs of ``LEAF_WORDS`` words with the white space around them, hashed together with
their place in the paragraph. The node of a paragraph hashes the whole digests of its leaves, that of a section the nodes
of its paragraphs, the root the nodes of the sections. A section ends after a paragraph whose node ends in 0, so an edit moves no section but
its own. The fingerprint is text: the root, then the tree of leaf hashes (their first digits), ``/`` between sections, ``;``
between paragraphs and ``,`` between leaves. Texts are equal if their roots are, and the branches that differ tell where they were edited.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from plantwatch.llm.store import partitions

LEAF_WORDS = 4
#: Hex digits of a leaf in the fingerprint, and of a paragraph's or section's node. Nodes hash all 64 digits of the leaves.
LEAF_DIGITS, NODE_DIGITS = 8, 32


def _hash(column, digits):
    return F.left(F.sha2(column, 256), F.lit(digits))


def fingerprint(text, leaf_words=LEAF_WORDS):
    """The fingerprint of a text column. Null and empty texts have one empty paragraph and equal fingerprints."""
    leaf = rf"\s*(?:\S+\s*){{1,{leaf_words}}}|\s+"

    def paragraph(line):
        leaves = F.transform(F.regexp_extract_all(line, F.lit(leaf), F.lit(0)), lambda x, i: F.sha2(F.concat(i.cast("string"), F.lit(":"), x), 256))
        return F.array_join(leaves, ",")

    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    # a paragraph as leaves:node; a section ends where a node ends in 0
    short = F.lit(f"([0-9a-f]{{{LEAF_DIGITS}}})[0-9a-f]{{{64 - LEAF_DIGITS}}}")
    nodes = F.transform(F.transform(lines, paragraph), lambda p: F.concat(F.regexp_replace(p, short, F.lit("$1")), F.lit(":"), _hash(p, NODE_DIGITS)))
    sections = F.split(F.array_join(nodes, ";"), "(?<=0);", -1)
    inside = F.transform(sections, lambda s: F.regexp_replace(s, r":[0-9a-f]+", ""))
    of_sections = F.transform(sections, lambda s: _hash(F.regexp_replace(s, r"[0-9a-f,]*:", ""), NODE_DIGITS))
    root = F.sha2(F.array_join(of_sections, ","), 256)
    return F.concat(root, F.lit("/"), F.array_join(inside, "/"))


def _sections(mark):
    return F.split(F.substring(mark, 66, 2**31 - 1), "/", -1)


def _parts(branches, sign):
    """The distinct branches one level below."""
    return F.array_distinct(F.flatten(F.transform(branches, lambda x: F.split(x, sign, -1))))


def differing(a, b):
    """Columns of the leaves of ``a`` that ``b`` does not have, and of all leaves of ``a``, both distinct.

    Both trees are walked from the root: sections in both are left, of the others the paragraphs in both, and of the rest
    the leaves are compared.
    """
    own, other = _sections(a), _sections(b)
    for sign in ";", ",":
        own, other = _parts(F.array_except(own, other), sign), _parts(F.array_except(other, own), sign)
    every = _parts(_parts(_sections(a), ";"), ",")
    return F.array_remove(F.array_except(own, other), ""), F.array_remove(every, "")


def likeness(a, b):
    """One less the share of leaves in branches that differ, of the leaves of both fingerprints; 1 for equal roots."""
    (apart_a, all_a), (apart_b, all_b) = differing(a, b), differing(b, a)
    apart, most = F.size(apart_a) + F.size(apart_b), F.size(all_a) + F.size(all_b)
    return F.when(F.left(a, F.lit(64)) == F.left(b, F.lit(64)), 1.0).when(most == 0, 0.0).otherwise((most - apart) / most)


def edited_sections(a, b):
    """Numbers of the sections of ``a``, from 0, that ``b`` does not have."""
    own, other = _sections(a), _sections(b)
    places = F.transform(own, lambda s, i: F.when(~F.array_contains(other, s), i))
    return F.filter(places, lambda i: i.isNotNull())


def with_next(docs, id_column="doc_id", text_column="text", **derived):
    """``doc_id``, ``text`` and ``next_text``: the text that follows in descending order of ids, after the last the first.

    ``derived`` are columns by functions of the text, worked out once a row; each comes with its ``next_`` column.

    Null texts are empty, null ids come last, rows that share an id are ordered by text. The ids are cut at quantiles into
    four cells for each shuffle partition of the session. The row at the upper end of a cell is also sent to the cell above
    it, so each cell is put in order on its own.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    held = ["text", *derived]
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-2**63)))
    n = 4 * partitions(docs)
    shares = F.array(*[F.lit((k + 1) / n) for k in range(n)])
    ends, last = rows.agg(F.percentile_approx("key", shares, 10 * n), F.max("key")).first()
    ends = sorted({*ends, last}) if ends else [0]
    # the number of ends below the key, in two steps: among the last ends of blocks, then inside one block
    block = math.isqrt(len(ends)) + 1
    all_ends, last_ends = F.array(*map(F.lit, ends)), F.array(*map(F.lit, [*ends[block - 1::block], 2**63 - 1]))
    rows = rows.withColumn("cell", F.size(F.filter(last_ends, lambda e: e < F.col("key"))) * block)
    rows = rows.withColumn("cell", F.col("cell") + F.size(F.filter(F.slice(all_ends, F.col("cell") + 1, F.lit(block)), lambda e: e < F.col("key"))))
    at_end = F.get(all_ends, F.col("cell")) == F.col("key")
    own = F.array(F.struct(F.col("cell").alias("cell"), F.lit(0).alias("guest")))
    above = F.array(F.struct(((F.col("cell") + 1) % len(ends)).alias("cell"), F.lit(1).alias("guest")))
    rows = rows.withColumns({name: function(F.col("text")) for name, function in derived.items()})
    rows = rows.withColumn("place", F.explode(F.when(at_end, F.concat(own, above)).otherwise(own)))
    order = Window.partitionBy("place.cell").orderBy("place.guest", F.col("key").desc(), "text")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in held})
    return rows.filter("place.guest = 0").select("doc_id", *held, *[f"next_{c}" for c in held])


def document_fingerprints(docs, id_column="doc_id", text_column="text", leaf_words=LEAF_WORDS):
    """Per row: ``doc_id``, ``n_chars``, the SHA-256 of the edited text, both fingerprints and two likenesses.

    The edited text is the text with its last third (``floor(n_chars / 3)`` code points) replaced by as many of the
    next document's first code points, or all of them if it has fewer. ``near_edited`` is the likeness of the
    fingerprints of the text and the edited text, ``near_next`` that of the text and the next text. ``edited_sections``
    numbers the sections that the edit changed. Repeated rows come back repeated; see ``with_next`` for ties and nulls.
    Other columns are left out, whatever their names; an empty table gives an empty result.
    Very long texts are fingerprinted whole; a text and its fingerprints are values of one row.
    """
    rows = with_next(docs, id_column, text_column, fingerprint=lambda text: fingerprint(text, leaf_words)).withColumn("n_chars", F.length("text").cast("bigint"))
    cut = F.expr("cast(n_chars div 3 as int)")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.length("text") - cut), F.left("next_text", cut)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                       fingerprint(F.col("edited"), leaf_words).alias("edited_fingerprint"), "next_fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
                       edited_sections(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edited_sections"))
