"""Row-order operators that stay exact when one machine holds a large part of all rows.

A window over a machine's whole history is one task. Here the history is cut into time chunks, and each chunk
gets copies of the few rows next to it, so that a frame of k rows sees the same neighbours as in the uncut history.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.functions.times import event_time
from plantwatch.rules import CASCADES
from plantwatch.session import stored

#: Length of the prefix of the order text at which a history can be cut: the second and four signs of the event id.
PREFIX = 25
def order_text():
    """Event order as one text: fixed-width time, then event id."""
    return F.concat(F.coalesce("timestamp", F.lit("")), F.lit("|"), F.coalesce(F.col("event_id").cast("string"), F.lit("")))


@dataclass(frozen=True)
class Chunks:
    """How histories are cut: by a prefix length of the order text for all keys, or where ``starts`` says for some keys."""

    width: int = 0
    starts: DataFrame | None = None


def choose_chunks(df, keys=("machine_id",), max_rows=1_000_000, counts=None):
    """Cut only the keys with more than ``max_rows`` rows; with none of them the histories stay whole.

    ``counts`` (the keys and ``n``) saves the count of the rows where it is known.
    """
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    large = counts.filter(F.col("n") > max_rows).select(*keys)
    return Chunks() if large.isEmpty() else Chunks(starts=chunk_starts(df, large, keys, max_rows))


def chunk_starts(df, large, keys=("machine_id",), max_rows=1_000_000):
    """Where each large key's chunks start: an array of prefixes of the order text, by cumulative counts.

    Each key is cut by its own counts, wherever its rows lie, so a burst gets many chunks and the quiet time around it few.
    A chunk has fewer than ``max_rows`` rows and those of one prefix (a second and four signs of the id). Counts are
    added up within hours and over hours, so no task holds a whole history.
    """
    keys, ordered = list(keys), order_text()
    counts = df.join(large, keys, "left_semi").groupBy(
        *keys, F.substring(ordered, 1, 13).alias("hour"), F.substring(ordered, 1, PREFIX).alias("start")).agg(F.count("*").alias("n"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    hours = counts.groupBy(*keys, "hour").agg(F.sum("n").alias("n"))
    hours = hours.select(*keys, "hour", F.coalesce(F.sum("n").over(earlier(*keys).orderBy("hour")), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(earlier(*keys, "hour").orderBy("start")), F.lit(0))
    placed = counts.withColumn("inside", inside).join(hours, [*keys, "hour"])
    chunk = F.floor((F.col("before") + F.col("inside")) / max(1, max_rows))
    starts = placed.groupBy(*keys, chunk.alias("chunk")).agg(F.min("start").alias("start"))
    return starts.groupBy(*keys).agg(F.array_sort(F.collect_list("start")).alias("_starts"))


def with_neighbours(df, before=0, after=0, width=None, keys=("machine_id",), max_rows=1_000_000):
    """Rows with ``_ord``, ``_chunk`` and ``_copy``: each chunk plus copies of the rows next to it.

    Windows partitioned by the keys and ``_chunk`` and ordered by ``_ord`` are then exact for frames of up to
    ``before`` rows back and ``after`` rows ahead; drop the copies afterwards. Only those few rows per chunk are
    moved to build the copies. ``width`` is a prefix length for all keys, a ``Chunks``, or None to choose.
    """
    keys = list(keys)
    plan = choose_chunks(df, keys, max_rows) if width is None else width if isinstance(width, Chunks) else Chunks(width)
    rows = df.withColumn("_ord", order_text())
    if plan.starts is not None:
        rows = rows.join(plan.starts, keys, "left")
        reached = _starts_up_to("_starts", F.substring("_ord", 1, PREFIX))
        chunk = F.when(F.col("_starts").isNotNull(), F.lpad(reached.cast("string"), 9, "0")).otherwise(F.lit(""))
        rows = rows.withColumn("_chunk", chunk).drop("_starts")
        cut = rows.filter(F.col("_chunk") != "")
    elif plan.width:
        rows = cut = rows.withColumn("_chunk", F.substring("_ord", 1, plan.width))
    else:
        return rows.withColumns({"_chunk": F.lit(""), "_copy": F.lit(False)})
    result = rows.withColumn("_copy", F.lit(False))
    if before:
        result = result.unionByName(_copies(cut, keys, before, F.asc("_ord"), F.desc("_ord")))
    if after:
        result = result.unionByName(_copies(cut, keys, after, F.desc("_ord"), F.asc("_ord")))
    return result


def _starts_up_to(starts, place):
    """How many of the sorted starts are not after a place: first among every so many of them, then inside one stretch, so
    the work for a row grows with the root of the number of chunks."""
    n = F.size(starts)
    stretch = F.greatest(F.lit(1), F.floor(F.sqrt(n)).cast("int"))
    heads = F.transform(F.sequence(F.lit(0), n - 1, stretch), lambda i: F.get(starts, i))
    full = F.greatest(F.lit(0), F.size(F.filter(heads, lambda start: start <= place)) - 1) * stretch
    return full + F.size(F.filter(F.slice(starts, full + 1, stretch), lambda start: start <= place))


def _copies(rows, keys, k, towards, away):
    """The k rows that lie just outside each chunk, labelled with that chunk."""
    edge = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(away)))
    edge = edge.filter(F.col("_r") <= k).drop("_r")
    history = Window.partitionBy(*keys).orderBy(towards)
    moved = [c for c in rows.columns if c not in keys and c != "_chunk"]
    entry = edge.select(
        *keys, "_chunk", F.lag("_chunk").over(history).alias("_prev"),
        F.collect_list(F.struct(*moved)).over(history.rowsBetween(-k, -1)).alias("_near"))
    entry = entry.filter(F.col("_prev").isNotNull() & (F.col("_prev") != F.col("_chunk")))
    return entry.select(*keys, "_chunk", F.explode("_near").alias("_n")).select(
        *keys, "_chunk", "_n.*", F.lit(True).alias("_copy"))


def chunk_window(keys=("machine_id",)):
    return Window.partitionBy(*keys, "_chunk").orderBy("_ord")


def without_copies(df):
    return df.filter(~F.col("_copy")).drop("_ord", "_chunk", "_copy")


def status_transitions(df, width=None, max_rows=1_000_000):
    """Rows where a machine's status differs from its previous one."""
    rows = with_neighbours(df.select("machine_id", "timestamp", "event_id", "status"), before=1, width=width,
                           max_rows=max_rows)
    rows = rows.withColumn("previous_status", F.lag("status").over(chunk_window()))
    return without_copies(rows).filter(
        F.col("previous_status").isNotNull() & ~F.col("status").eqNullSafe(F.col("previous_status"))
    ).select("machine_id", "timestamp", "event_id", "previous_status", "status")


def anomaly_episodes(df, width=None, max_rows=1_000_000):
    """Runs of one anomaly on one machine: start, end, duration in seconds, events and greatest severity.

    Runs are numbered within chunks; a per-chunk count of run starts, added up over the machine's chunks, turns
    that into a number over the whole history. The rows of a run are aggregated before they are shuffled together.
    """
    rows = df.select("machine_id", "machine_type", "timestamp", "event_id",
                     F.when(F.col("anomaly_detected"), F.coalesce("anomaly_type", F.lit("unknown"))).alias("kind"),
                     "anomaly_severity")
    plan = choose_chunks(rows, max_rows=max_rows) if width is None else Chunks(width)
    rows = with_neighbours(rows, before=1, width=plan)
    w = chunk_window()
    rows = rows.withColumn("begins", ~F.col("kind").eqNullSafe(F.lag("kind").over(w)) | F.lag("_ord").over(w).isNull())
    rows = rows.filter(~F.col("_copy"))
    rows = rows.withColumn("local", F.sum(F.col("begins").cast("bigint")).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy("machine_id", "_chunk", "local").agg(
        F.max("kind").alias("kind"), F.max("machine_type").alias("machine_type"),
        F.min(F.struct("timestamp", "event_id")).alias("start"), F.max(F.struct("timestamp", "event_id")).alias("end"),
        F.count("*").alias("events"), F.max("anomaly_severity").alias("max_severity"))
    if plan.width or plan.starts is not None:
        starts = rows.groupBy("machine_id", "_chunk").agg(F.count_if(F.col("begins")).alias("starts"))
        earlier = Window.partitionBy("machine_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = starts.select("machine_id", "_chunk", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("offset"))
        parts = parts.join(offsets, ["machine_id", "_chunk"]).withColumn("run", F.col("offset") + F.col("local"))
    else:
        parts = parts.withColumn("run", F.col("local"))
    runs = parts.groupBy("machine_id", "run").agg(
        F.max("machine_type").alias("machine_type"), F.max("kind").alias("anomaly_type"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("events").alias("events"),
        F.max("max_severity").alias("max_severity"))
    seconds = F.unix_timestamp(event_time(F.col("end.timestamp"))) - F.unix_timestamp(event_time(F.col("start.timestamp")))
    return runs.filter("anomaly_type IS NOT NULL").select(
        "machine_id", "machine_type", "anomaly_type", F.col("start.timestamp").alias("start_time"),
        F.col("end.timestamp").alias("end_time"), F.col("start.event_id").alias("start_event_id"),
        seconds.alias("duration_seconds"), "events", "max_severity")


def cascade_links(episodes, rules=None, width=None, max_rows=1_000_000):
    """The rows of ``anomaly_cascades`` with the start and the first event of both episodes."""
    named = episodes.select(
        "machine_id", "machine_type", F.col("start_time").alias("timestamp"), F.col("start_event_id").alias("event_id"),
        "anomaly_type", "end_time", "max_severity")
    rows = with_neighbours(named, before=1, width=width, max_rows=max_rows)
    w = chunk_window()
    rows = rows.withColumns({
        "source_anomaly": F.lag("anomaly_type").over(w), "source_end": F.lag("end_time").over(w),
        "source_severity": F.lag("max_severity").over(w), "source_start": F.lag("timestamp").over(w), "source_event_id": F.lag("event_id").over(w)})
    allowed = F.lit(False)
    for source, target, threshold in rules or CASCADES:
        allowed = allowed | ((F.col("source_anomaly") == source) & (F.col("anomaly_type") == target)
                             & (F.col("source_severity") >= threshold))
    return without_copies(rows).filter(allowed)


def anomaly_cascades(episodes, rules=None, width=None, max_rows=1_000_000):
    """Successive episodes of a machine where the first can set off the second, by the cascade table."""
    return cascade_links(episodes, rules, width, max_rows).select(
        "machine_id", "machine_type", "source_anomaly", F.col("anomaly_type").alias("target_anomaly"), "source_end",
        F.col("timestamp").alias("target_start"), "source_severity", F.col("max_severity").alias("target_severity"))


def cascade_history(episodes, rules=None, width=None, max_rows=1_000_000):
    """Every episode that another one set off: where its chain began (``root_start``, ``root_anomaly``) and how many links back.

    Pointers are doubled: in each round an episode takes over the pointer of the one that it points to, so a chain of n links is
    done after about log2(n) rounds, however long the history. A round is a join of the links with themselves, by machine and
    episode, in which no two episodes look up the same one but the roots, and it is stored, so nothing runs twice.
    """
    links = cascade_links(episodes, rules, width, max_rows)
    node = lambda time, event: F.struct(F.col(time).alias("time"), F.col(event).alias("event"))
    steps = stored(links.select("machine_id", node("timestamp", "event_id").alias("episode"), "anomaly_type", node("source_start", "source_event_id").alias("up"),
                                F.col("source_anomaly").alias("root_anomaly"), F.lit(1).cast("long").alias("depth")), "cascade-links")
    while True:
        above = steps.select("machine_id", F.col("episode").alias("up"), F.col("up").alias("next"), F.col("root_anomaly").alias("next_anomaly"), F.col("depth").alias("more"))
        jumped = steps.join(above, ["machine_id", "up"], "left")
        moved = F.col("more").isNotNull()
        steps = stored(jumped.select("machine_id", "episode", "anomaly_type", F.coalesce("next", "up").alias("up"), F.coalesce("next_anomaly", "root_anomaly").alias("root_anomaly"),
                                     (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), moved.alias("moved")), "cascade-links")
        if steps.filter("moved").isEmpty():
            break
        steps = steps.drop("moved")
    return steps.select("machine_id", F.col("up.time").alias("root_start"), F.col("up.event").alias("root_event_id"), "root_anomaly", "depth",
                        F.col("episode.time").alias("start_time"), F.col("episode.event").alias("start_event_id"), "anomaly_type")


def cascade_chains(history):
    """Per chain its root, its last episode and how many episodes it has, from ``cascade_history``."""
    last = F.max_by(F.struct("start_time", "anomaly_type"), "depth")
    chains = history.groupBy("machine_id", "root_start", "root_event_id", "root_anomaly").agg((F.max("depth") + 1).alias("episodes"), last.alias("last"))
    return chains.select("machine_id", "root_start", "root_anomaly", "episodes", F.col("last.start_time").alias("last_start"), F.col("last.anomaly_type").alias("last_anomaly"))


def alarm_periods(df, breach_value, threshold, seconds=60, periods=2, group="machine_type"):
    """Periods at whose end an alarm is on: the value exceeded the threshold in the last ``periods`` periods.

    ``breach_value`` is the aggregate of one period. Each breaching period is copied to the few periods it counts
    for and these are counted, so no window over a whole series is needed.
    """
    start = (F.floor(F.unix_timestamp(event_time()) / seconds) * seconds).cast("bigint")
    per_period = df.groupBy(group, start.alias("start")).agg(breach_value.alias("value"))
    breaches = per_period.filter(F.col("value") > threshold)
    counted = breaches.select(
        group, F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("later"), "start", "value").select(
        group, (F.col("start") + F.col("later") * seconds).alias("start"), "later", "value")
    return counted.groupBy(group, "start").agg(
        F.count("*").alias("breaches"), F.max(F.when(F.col("later") == 0, F.col("value"))).alias("value")
    ).filter(F.col("breaches") == periods).select(
        group, F.date_format(F.timestamp_seconds("start"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("period_start"), "value")
