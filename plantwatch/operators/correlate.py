"""Failures of one machine type that show up on the machines depending on it."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plantwatch.functions.times import event_time
from plantwatch.rules import EXPOSURES


def failing():
    """Rule name of a row whose machine disturbs others, and how severely."""
    worst = F.greatest(F.col("anomaly_severity"), F.col("degradation_level"))
    anomalous = F.coalesce(F.col("anomaly_detected"), F.lit(False))
    kind, level = F.col("anomaly_type"), F.col("degradation_level")
    cases = [
        ("cooling_system", anomalous | (level >= 0.3), "cooling_failure", worst),
        ("industrial_turbine", anomalous & (kind == "vibration_anomaly"), "turbine_vibration", F.col("anomaly_severity")),
        ("cnc_machine", anomalous & (kind == "excessive_tool_wear"), "cnc_tool_wear", F.col("anomaly_severity")),
        ("robotic_arm", anomalous | (level >= 0.4), "arm_overload", worst),
    ]
    rule = severity = F.lit(None)
    for machine, condition, name, value in cases:
        here = (F.col("machine_type") == machine) & condition
        rule, severity = F.when(here, name).otherwise(rule), F.when(here, value).otherwise(severity)
    return rule.alias("rule"), severity.alias("severity")


def _sources(df, exposures, when):
    """Failing machines and their severities, summed per rule and bucket; a machine counts once in each."""
    origins = [source for _, source, _, _ in exposures]
    failures = df.filter(F.col("machine_type").isin(origins)).select("machine_id", when, *failing()).filter("rule IS NOT NULL")
    per_machine = failures.groupBy("rule", "time_bucket", "machine_id").agg(F.max("severity").alias("severity"))
    return per_machine.groupBy("rule", "time_bucket").agg(
        F.count("*").alias("source_machines"), F.sum("severity").alias("severity_sum"),
        F.max("severity").alias("max_severity"))


def dependants_of(exposures):
    """Machine types that a rule acts on, as an array."""
    pairs = F.lit(None).cast("array<string>")
    for name, _, dependants, _ in reversed(exposures):
        pairs = F.when(F.col("rule") == name, F.array(*[F.lit(d) for d in dependants])).otherwise(pairs)
    return pairs


def rules_on(exposures):
    """Rules that act on a machine type, as an array."""
    acting = F.lit(None).cast("array<string>")
    for dependant in sorted({d for _, _, types, _ in exposures for d in types}):
        names = [F.lit(name) for name, _, types, _ in exposures if dependant in types]
        acting = F.when(F.col("machine_type") == dependant, F.array(*names)).otherwise(acting)
    return acting


def correlated_failures(df, width=13, exposures=None):
    """Exposure of each dependent machine per time bucket and rule, with the expected change of its sensors.

    Every failing machine acts on every dependent one at the same time, and the effects add up. So the sources are
    summed first, to one row per rule and bucket, and joined to one row per dependent machine and bucket: the result
    grows with the machines, never with source times target events. ``width`` is the prefix length of a bucket.
    """
    exposures = exposures or EXPOSURES
    bucket = F.substring("timestamp", 1, width).alias("time_bucket")
    sources = _sources(df, exposures, bucket)
    reach = sources.select("*", F.explode(dependants_of(exposures)).alias("machine_type"))
    dependants = sorted({d for _, _, types, _ in exposures for d in types})
    present = ["temperature", "motor_temperature", "power_consumption", "energy_usage", "alignment_accuracy",
               "cycle_efficiency", "rpm"]
    targets = df.filter(F.col("machine_type").isin(dependants)).groupBy("machine_id", "machine_type", bucket).agg(
        F.count("*").alias("events"), *[F.count(s).alias(f"n_{s}") for s in present])

    def change(sensor):
        total = F.lit(None).cast("double")
        for name, _, _, effects in exposures:
            if sensor in effects:
                total = F.when((F.col("rule") == name) & (F.col(f"n_{sensor}") > 0),
                               F.col("severity_sum") * effects[sensor]).otherwise(total)
        return total.alias(f"{sensor}_change")

    return targets.join(reach, ["machine_type", "time_bucket"]).select(
        "machine_id", "machine_type", "time_bucket", "rule", "events", "source_machines", "max_severity", "severity_sum",
        *[change(s) for s in present])


def disturbances(df, distance=3600, exposures=None, cell=86400):
    """Spans ``(rule, machine_id, opened, closed, severity)`` in which a failing machine disturbs its dependants, in seconds.

    A failure at second t acts from t + 1 to t + ``distance``, or to the second in which the same machine fails again: from then
    on the newer failure counts. A machine's spans don't overlap, so it counts once at any time. Of failures in one second
    the most severe counts. Histories are cut into cells of time; the failures of the first ``distance`` seconds of a cell
    are also shown to the cell before it, which needs them to close its own spans.
    """
    exposures, cell = exposures or EXPOSURES, max(cell, distance)
    origins = [source for _, source, _, _ in exposures]
    second = F.unix_timestamp(event_time()).alias("opened")
    failures = df.filter(F.col("machine_type").isin(origins)).select("machine_id", second, *failing()).filter("rule IS NOT NULL AND opened IS NOT NULL")
    failures = failures.groupBy("rule", "machine_id", "opened").agg(F.coalesce(F.max("severity"), F.lit(0.0)).alias("severity"))
    own = F.floor(F.col("opened") / cell)
    cells = F.when(F.col("opened") - own * cell < distance, F.array(own, own - 1)).otherwise(F.array(own))
    placed = failures.select("*", F.explode(cells).alias("cell"))
    after = F.lead("opened").over(Window.partitionBy("rule", "machine_id", "cell").orderBy("opened"))
    closed = F.least(F.col("opened") + distance, F.coalesce(after, F.col("opened") + distance))
    return placed.withColumn("closed", closed).filter(F.col("cell") == own).select("rule", "machine_id", "opened", "closed", "severity")


def _blocks(distance):
    """The seconds after ``opened`` up to ``closed`` as few aligned blocks: (level, number), block n of level k being the
    seconds from n * 2^k to (n + 1) * 2^k - 1."""
    first, end = "-shiftright(-(opened + 1), k)", "shiftright(closed + 1, k)"
    found = f"""flatten(transform(sequence(0, {max(0, distance.bit_length() - 1)}), k -> filter(array(
        if({first} < {end} AND {first} & 1 = 1, struct(k AS level, {first} AS number), null),
        if({first} < {end} AND {end} & 1 = 1, struct(k AS level, {end} - 1 AS number), null)), b -> b IS NOT NULL)))"""
    return F.explode(F.expr(found)).alias("block")


def disturbed_seconds(spans, distance=3600):
    """Per rule and second: how many machines disturb, the sum of their severities and the greatest.

    Spans are added up by where they begin and end, then cut into aligned blocks of seconds and added up by block, then
    blocks are laid out to seconds. So the rows are at most seconds times rules times the logarithm of ``distance``,
    however many machines fail, and no second's machines meet in one task.
    """
    sums = lambda n: [F.sum(n).alias("source_machines"), F.sum("severity_sum").alias("severity_sum"), F.max("max_severity").alias("max_severity")]
    spans = spans.select("rule", "opened", "closed", F.lit(1).alias("n"), F.col("severity").alias("severity_sum"), F.col("severity").alias("max_severity"))
    edges = spans.groupBy("rule", "opened", "closed").agg(*sums("n"))
    blocks = edges.select("*", _blocks(distance)).groupBy("rule", "block").agg(*sums("source_machines"))
    start = F.expr("shiftleft(block.number, block.level)")
    seconds = F.explode(F.sequence(start, start + F.expr("shiftleft(1L, block.level)") - 1)).alias("second")
    return blocks.select("rule", seconds, "source_machines", "severity_sum", "max_severity").groupBy("rule", "second").agg(*sums("source_machines"))


def correlated_within(df, distance=3600, width=13, exposures=None):
    """Exposure of each dependent machine per time bucket and rule to failures up to ``distance`` seconds before.

    Time counts to the second: a failure at t acts on events from t + 1 to t + ``distance``, neither on those of its own second
    nor on those before or beyond. At each moment a machine counts once, with its latest failure (``disturbances``).
    ``events`` counts the exposed events; the other figures are the greatest that an event of the bucket meets. Events are
    counted per machine and second and joined to one row per rule and second, never to the failures. Rows without a
    readable time take no part. Spark takes the seconds laid out to be as small as the table they come from and would send
    millions of them through the driver; the hint keeps both sides of the join shuffled.
    """
    exposures = exposures or EXPOSURES
    reach = disturbed_seconds(disturbances(df, distance, exposures), distance)
    dependants = sorted({d for _, _, types, _ in exposures for d in types})
    bucket, second = F.substring("timestamp", 1, width).alias("time_bucket"), F.unix_timestamp(event_time()).alias("second")
    targets = df.filter(F.col("machine_type").isin(dependants)).groupBy("machine_id", "machine_type", bucket, second).agg(F.count("*").alias("events"))
    targets = targets.select("*", F.explode(rules_on(exposures)).alias("rule"))
    return targets.join(reach.hint("merge"), ["rule", "second"]).groupBy("machine_id", "machine_type", "time_bucket", "rule").agg(
        F.sum("events").alias("events"), *[F.max(c).alias(c) for c in ("source_machines", "severity_sum", "max_severity")])
