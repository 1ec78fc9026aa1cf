"""Scores, bands and statuses of single readings, as column expressions."""

from pyspark.sql import functions as F

from plantwatch import rules
from plantwatch.functions.numbers import exact_round
from plantwatch.functions.text import first_match, quoted


def _first(*names):
    return F.coalesce(*[F.col(n) for n in names])


def health_parts(efficiency_target=0.80):
    """Six part scores of 0..100; a sensor the machine does not have scores 100."""
    temperature = _first("temperature", "motor_temperature")
    vibration = F.col("vibration")
    power = _first("power_consumption", "energy_usage", "energy_output")
    pressure = _first("pressure", "hydraulic_pressure")
    efficiency = _first("cycle_efficiency", "task_completion_rate")
    degradation = F.col("degradation_level")

    def falling(value, limit, slope):
        return F.when(value > limit, F.greatest(F.lit(20.0), 100.0 - (value - limit) * slope)).otherwise(100.0)

    return {
        "temperature": falling(temperature, 75.0, 2.0),
        "vibration": falling(vibration, 5.0, 15.0),
        "power": F.when(power < 5.0, F.greatest(F.lit(40.0), 100.0 - (5.0 - power) * 10.0))
                  .when(power > 120.0, F.greatest(F.lit(20.0), 100.0 - (power - 120.0) * 1.5)).otherwise(100.0),
        "pressure": falling(pressure, 250.0, 0.5),
        "efficiency": F.when(efficiency < efficiency_target,
                             F.greatest(F.lit(20.0), 100.0 - (efficiency_target - efficiency) * 200.0)).otherwise(100.0),
        "degradation": F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1.0 - degradation) * 100.0)), F.lit(100.0)),
    }


def health_score(weights=None, efficiency_target=0.80):
    """Weighted score clamped to 25..98, one decimal."""
    parts = health_parts(efficiency_target)
    total = F.lit(0.0)
    for name, weight in (weights or rules.HEALTH_WEIGHTS).items():
        total = total + parts[name] * weight
    return exact_round(F.greatest(F.lit(25.0), F.least(F.lit(98.0), total)), 1)


def health_status(score):
    return F.when(score < 50.0, "critical").when(score < 80.0, "warning").otherwise("healthy")


def derive_status(previous=None):
    """Status from degradation and severity; an offline machine stays offline."""
    worst = F.greatest(F.coalesce(F.col("degradation_level"), F.lit(0.0)), F.coalesce(F.col("anomaly_severity"), F.lit(0.0)))
    status = F.when(worst >= 0.80, "critical").when(worst >= 0.50, "warning").otherwise("healthy")
    return status if previous is None else F.when(previous == "offline", "offline").otherwise(status)


def severity_band(severity):
    return (F.when(severity >= 0.75, "Critical").when(severity >= 0.40, "High")
            .when(severity >= 0.10, "Medium").otherwise("Low"))


def evidence_band(confidence):
    percent = confidence * 100
    return F.when(percent < 40, "Weak evidence").when(percent < 70, "Moderate evidence").otherwise("Strong evidence")


def priority_band(confidence):
    percent = F.floor(confidence * 100 + 0.5)
    return (F.when(percent >= 80, "Critical").when(percent >= 60, "High")
            .when(percent >= 40, "Medium").otherwise("Low"))


def gauge_band(value, limits):
    """Gauge colour of one sensor; a missing reading is healthy."""
    def outside(level):
        hit = value > limits[f"{level}_above"]
        return hit | (value < limits[f"{level}_below"]) if f"{level}_below" in limits else hit
    return F.when(outside("critical"), "critical").when(outside("warning"), "warning").otherwise("healthy")


_ALERT_WORDS = "lower(replace(anomaly_type, '_', ' '))"


def alert_explanation():
    """Explanation by the words in the row's anomaly type."""
    rest = f"format_string({quoted(rules.ALERT_DEFAULT_EXPLANATION)}, anomaly_type)"
    return F.expr(first_match(_ALERT_WORDS, [(w, quoted(e)) for w, e, _ in rules.ALERT_TEXTS], rest))


def alert_action():
    return F.expr(first_match(_ALERT_WORDS, [(w, quoted(a)) for w, _, a in rules.ALERT_TEXTS],
                              quoted(rules.ALERT_DEFAULT_ACTION)))


def maintenance(degradation):
    """Failure risk, remaining life, trend and advice from one degradation level, as a list of columns."""
    level = F.coalesce(degradation, F.lit(0.0))
    return [
        exact_round(level * 100.0, 1).alias("failure_risk_pct"),
        exact_round(F.greatest(F.lit(1.0), (1.0 - level) * 150.0), 1).alias("remaining_useful_life_days"),
        _from_level(level, 1).alias("health_trend"),
        _from_level(level, 2).alias("maintenance_recommendation"),
    ]


def _from_level(level, field):
    """A field of the first maintenance rule whose level is reached."""
    *reached, (_, *rest) = rules.MAINTENANCE
    value = F.lit(rest[field - 1])
    for row in reversed(reached):
        value = F.when(level >= row[0], row[field]).otherwise(value)
    return value
