"""Compression of vectors to codes: a codebook for each part of the vector, fitted by k-means over all rows with exact integers.

A round assigns every part to the nearest entry of its codebook and then moves the entries. Most distances need no
computing. A row keeps a lower bound of its distance to each entry, and the round in which the bound was taken (its stamp);
all codebooks of the past are kept. An entry that lay at distance d in round s is now at least d minus its net displacement
from round s to now away: the norm of the sum of its moves, never more than the sum of their norms. Entries whose bound
exceeds the distance to the row's own entry are out; the others are measured anew, and their bounds with them.

Bounds are rounded down and displacements up, to whole numbers, so rounding can't change an assignment. A round is one pass:
it reads the rows with their bounds, writes them with the new ones, and adds up the parts of each entry on the way.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from plantwatch.llm.store import release, removed, shared_dir, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of the pieces in which sums travel, so that sums of any size are exact.
LIMB = 40
#: Labels with this share of the rows are joined by broadcast, so there are at most as many as its inverse.
HOT = 1e-4
_MOST = np.iinfo(np.uint16).max


def cuts(length, parts=PARTS):
    """Where the parts begin and end: equal parts, or nearly so if the length can't be divided."""
    return [length * k // parts for k in range(parts + 1)]


def as_integers(values, wide):
    """``floor(4096 x)`` of an array of doubles; ``wide`` ones become Python's integers."""
    if not wide:
        return np.floor(values * SCALE).astype(np.int64)
    whole = np.empty(values.size, object)
    whole[:] = [math.floor(x * SCALE) if abs(x) < 1e300 else math.floor(x) * SCALE for x in values.ravel().tolist()]
    return whole.reshape(values.shape)


def squared(a, b):
    """Squared distances of the rows of two arrays of integers."""
    return ((a - b) ** 2).sum(axis=-1)


def root_down(squares):
    """Whole numbers that are not above the square roots."""
    if squares.dtype == object:
        return np.array([math.isqrt(s) for s in squares.ravel().tolist()], object).reshape(squares.shape)
    return np.maximum(np.sqrt(squares).astype(np.int64) - 1, 0)


def root_up(squares):
    """Whole numbers that are not below the square roots."""
    return root_down(squares) + (1 if squares.dtype == object else 3)


class Rows:
    """Some rows: integer vectors, the entry of each part, and for each entry a bound (in quanta) and its stamp."""

    def __init__(self, vectors, entries, state=None):
        shape = (len(vectors), PARTS, entries)
        self.vectors, self.ends = vectors, cuts(vectors.shape[1])
        if state:
            self.codes, self.bounds, self.stamps = (np.frombuffer(data, kind).reshape(size).copy() for data, kind, size in zip(state, (np.uint8, "<u2", np.uint8), (shape[:2], shape, shape)))
        else:
            self.codes, self.bounds, self.stamps = np.zeros(shape[:2], np.uint8), np.zeros(shape, "<u2"), np.zeros(shape, np.uint8)

    def part(self, p):
        return self.vectors[:, self.ends[p]:self.ends[p + 1]]

    def assign(self, books, quantum):
        """Assign every part by the last of ``books``, the codebooks of all rounds so far.

        Returns the squared distances by part, and how many distances were computed.
        """
        now, each, measured = len(books) - 1, np.arange(len(self.vectors)), 0
        errors = np.zeros((len(each), PARTS), self.vectors.dtype)
        for p in range(PARTS):
            part, book, bounds, stamps = self.part(p), books[now][p], self.bounds[:, p], self.stamps[:, p]
            moved = np.array([root_up(squared(book, old[p])) for old in books])
            own = self.codes[:, p].astype(np.int64)
            to_own = squared(part, book[own])
            least = bounds.astype(self.vectors.dtype) * quantum - moved[stamps, np.arange(len(book))]
            near = least <= root_up(to_own)[:, None]
            near[each, own] = True
            rows, entries = np.nonzero(near)
            squares = squared(part[rows], book[entries])
            measured += len(rows)
            all_near = np.full(near.shape, math.inf if squares.dtype == object else np.iinfo(np.int64).max, squares.dtype)
            all_near[rows, entries] = squares
            nearest = np.argmin(all_near, axis=1)  # of equal ones the first
            bounds[rows, entries] = np.minimum(root_down(squares) // quantum, _MOST).astype(np.int64)
            stamps[rows, entries] = now
            self.codes[:, p], errors[:, p] = nearest, all_near[each, nearest]
        return errors, measured

    def sums(self, entries):
        """By slot (part and entry): the number of rows, and the sums of their parts by component, as one array."""
        width = max(b - a for a, b in zip(self.ends, self.ends[1:]))
        sums = np.zeros((PARTS, entries, 1 + width), self.vectors.dtype)
        for p in range(PARTS):
            part = self.part(p)
            np.add.at(sums[p, :, 0], self.codes[:, p], 1)
            np.add.at(sums[p, :, 1:1 + part.shape[1]], self.codes[:, p], part)
        return sums.reshape(PARTS * entries, 1 + width)


def limbs(value):
    """An integer as (limb, amount): the sum of amount * 2 ** (LIMB * limb)."""
    limb = 0
    while True:
        high = value >> LIMB
        if high in (0, -1) and -1 << 62 < value < 1 << 62:
            yield limb, value
            return
        yield limb, value - (high << LIMB)
        value, limb = high, limb + 1


def kept_rows(vectors, id_column="vec_id", vector_column="embedding", label_column="label"):
    """``vec_id``, ``label`` and ``vector`` (of doubles) of the rows whose vector has no null and no non-finite component."""
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vector").isNotNull()).filter(F.coalesce(fine, F.lit(False)))


class Codebooks:
    """Codebooks fitted to a table of vectors, and the table's rows with their codes.

    ``books`` holds the codebooks of all rounds, the last ones the result; ``rows`` the coded rows (``vec_id``, ``label``,
    ``code``, ``error``); ``measured`` the share of distances that had to be computed in each assignment.
    """

    def __init__(self, vectors, entries=ENTRIES, rounds=ROUNDS, **columns):
        self.spark, self.measured = vectors.sparkSession, []
        kept = kept_rows(vectors, **columns)
        sizes = kept.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vector", F.abs))).alias("top"))
        usual = sizes.orderBy(F.desc("n"), F.desc("length")).first()
        self.length, self.count = (usual["length"], usual["n"]) if usual else (0, 0)
        top = math.ceil((usual["top"] or 0.0) if usual else 0.0) * SCALE + 1
        width = max(1, -(-self.length // PARTS))
        self.wide = 4 * width * top**2 >= 1 << 62
        self.quantum = max(1, -(-2 * top * (math.isqrt(width) + 1) // _MOST))
        self.usual, self.other = kept.filter(F.size("vector") == self.length), kept.filter(F.size("vector") != self.length)
        first = self.usual.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
        start = as_integers(np.array([r["vector"] for r in first], np.float64).reshape(len(first), self.length), self.wide)
        ends = cuts(self.length)
        self.entries, self.books = len(first), [[start[:, a:b] for a, b in zip(ends, ends[1:])]]
        self.rows = self._fitted(rounds) if self.count else self._nothing()

    def _nothing(self):
        return self.usual.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))

    def _fitted(self, rounds):
        state, path = self.usual, None
        for _ in range(rounds):
            before, path = path, shared_dir(self.spark, "vector-codes")
            done = self._pass(state, "state")
            done.write.option("compression", "zstd").parquet(path)
            state = self.spark.read.schema(done.schema).parquet(path)
            self._move(state)
            state = state.filter("slot is null")
            if before:
                removed(before)
        coded = written(self._pass(state, "codes").select("vec_id", "label", "code", "error", "amount"), "codes", self.spark)
        self._note(coded.agg(F.sum("amount").alias("n")).first()["n"])
        if path:
            removed(path)
        return coded.filter("code is not null").drop("amount").union(self.other.select("vec_id", "label", F.lit(None).cast("string"), F.lit(None).cast("long")))

    def _note(self, measured):
        self.measured.append(int(measured) / (self.count * PARTS * self.entries))

    def _move(self, state):
        """The next codebook: every entry that was used goes to the mean of its parts, rounded down."""
        found = state.filter("slot is not null").groupBy("slot", "place", "limb").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect()
        totals = {}
        for slot, place, limb, amount in found:
            totals[slot, place] = totals.get((slot, place), 0) + (int(amount) << LIMB * limb)
        self._note(totals.pop((-1, 0)))
        books = [book.copy() for book in self.books[-1]]
        for p, book in enumerate(books):
            for e in range(self.entries):
                n = totals.get((p * self.entries + e, 0), 0)
                if n:
                    book[e] = [totals.get((p * self.entries + e, 1 + k), 0) // n for k in range(book.shape[1])]
        self.books.append(books)

    def _pass(self, rows, what):
        """One assignment of all rows. As ``state``: rows to go on from, and rows of sums; as ``codes``: codes and errors."""
        books, length, entries, quantum, wide, first = self.books, self.length, self.entries, self.quantum, self.wide, len(self.books) == 1
        own = [pa.field(c, to_arrow_type(rows.schema[c].dataType)) for c in ("vec_id", "label")]
        vector = pa.field("vector", pa.list_(pa.float64() if wide else pa.int32()))
        sums = [pa.field("slot", pa.int32()), pa.field("place", pa.int32()), pa.field("limb", pa.int32()), pa.field("amount", pa.int64())]
        if what == "state":
            schema = pa.schema([*own, vector, *[pa.field(c, pa.binary()) for c in ("codes", "bounds", "stamps")], *sums])
        else:
            schema = pa.schema([*own, pa.field("code", pa.string()), pa.field("error", pa.int64()), *sums])
        block = max(64, (1 << 18) // max(1, length))

        def blocks(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, block):
                    yield batch.slice(k, block)

        def run(batches):
            totals, measured = 0, 0
            for batch in blocks(batches):
                values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)
                vectors = as_integers(values, wide) if first or wide else values.astype(np.int64)
                some = Rows(vectors, entries, None if first else [b"".join(batch.column(c).to_pylist()) for c in ("codes", "bounds", "stamps")])
                errors, n = some.assign(books, quantum)
                measured += n
                if what == "codes":
                    whole = [int(e) for e in errors.sum(axis=1)]
                    new = [pa.array([c.tobytes().hex() for c in some.codes], pa.string()), pa.array([e if e < 1 << 63 else None for e in whole], pa.int64())]
                else:
                    totals = totals + some.sums(entries)
                    flat = pa.array((values if wide else vectors.astype(np.int32)).ravel())
                    new = [pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * length, flat), *[pa.array([x.tobytes() for x in column], pa.binary()) for column in (some.codes, some.bounds, some.stamps)]]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *new, *[pa.nulls(batch.num_rows, f.type) for f in sums]], schema=schema)
            found = [(-1, 0, 0, measured)]
            if what == "state" and measured:
                found += [(s, k, limb, amount) for s, k in np.ndindex(totals.shape) for limb, amount in limbs(int(totals[s, k])) if amount]
            numbers = [pa.array(c, f.type) for c, f in zip(zip(*found), sums)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(found), f.type) for f in schema][:-4], *numbers], schema=schema)
            release()

        return rows.mapInArrow(run, from_arrow_schema(schema))

    def digest(self):
        """SHA-256 of the decimal components of all final entries, by part, entry and place, with commas between."""
        numbers = (str(x) for book in self.books[-1] for entry in book for x in entry.tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def with_label_errors(rows):
    """The rows with ``label_error``: the error summed over all rows of the label. Very common labels are joined by broadcast."""
    totals = written(rows.groupBy("label").agg(F.count("*").alias("n"), F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error")), "label-errors")
    n = totals.agg(F.sum("n")).first()[0] or 0
    totals = totals.select(F.col("label").alias("total_of"), "n", "label_error")
    same = F.col("label").eqNullSafe(F.col("total_of"))
    marked = rows.join(F.broadcast(totals.filter(F.col("n") >= n * HOT)), same, "left")
    columns = [*rows.columns, "label_error"]
    rest = marked.filter("n is null").select(*rows.columns).join(totals.filter(F.col("n") < n * HOT), same)
    return marked.filter("n is not null").select(columns).union(rest.select(columns))


def vector_codes(vectors, entries=ENTRIES, rounds=ROUNDS, **columns):
    """Per kept row: ``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256``.

    Rows whose vector is null or holds a null or a non-finite component are dropped. A component x counts as the integer
    floor(4096 x), of any size. Vectors are cut into eight parts; if their length can't be divided, some parts are one
    longer. The codebooks start as the parts of the least ids (null ids come last, rows of one id go by their vectors), with
    fewer entries if there are fewer rows. Repeated rows count each. Vectors of another length than the commonest (of
    equally common ones the longest) get a null code and error. An error that 64 bits can't hold is null and missing in the
    sum of its label; null labels are one label. Other columns are not read. An empty table gives no rows. Vectors may be
    long: a task works on a bounded number of components at a time, and the codebooks (entries times length, for each
    round) go to every task.
    """
    books = Codebooks(vectors, entries, rounds, **columns)
    rows = with_label_errors(books.rows).select("vec_id", "code", "error", "label_error")
    return rows.withColumn("codebooks_sha256", F.lit(books.digest()))


def _sql(rounds=ROUNDS):
    """K-means by definition, every distance computed; one pair of steps for each round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, p, e, d FROM (SELECT vec_id, p, e, sum((x - c) * (x - c)) AS d FROM components JOIN book{r} USING (p, i) GROUP BY vec_id, p, e)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT p, e, i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
  FROM book{r} LEFT JOIN (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM near{r} JOIN components USING (vec_id, p) GROUP BY p, e, i) USING (p, e, i))""")
    steps = ",\n".join(steps)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding, len(embedding) AS length FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
components AS MATERIALIZED (
  SELECT vec_id, ((k - 1) * 8 // length)::INT AS p, ((k - 1) % (length // 8))::INT AS i, floor(4096 * embedding[k]::DOUBLE)::HUGEINT AS x
  FROM (SELECT vec_id, embedding, length, unnest(range(1, length + 1)) AS k FROM kept)),
book0 AS MATERIALIZED (
  SELECT p, e, i, x AS c FROM components JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 16) USING (vec_id)),
{steps},
codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), digest"""


SQL = _sql()
