"""Health observations: which payloads are taken, and in which canonical form and unit they are stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of each metric its units, the first being the one that is stored, and its fields with their limits.
UNITS = {
    "BLOOD_PRESSURE": ("mmHg",),
    "BLOOD_GLUCOSE": ("mg/dL", "mmol/L"),
    "HEART_RATE": ("bpm",),
    "OXYGEN_SATURATION": ("%",),
    "SLEEP_HOURS": ("h",),
}
FIELDS = {
    "BLOOD_PRESSURE": ("systolic", "diastolic", "pulse", "bodyPosition"),
    "BLOOD_GLUCOSE": ("glucose", "mealStatus"),
    "HEART_RATE": ("heartRate", "context"),
    "OXYGEN_SATURATION": ("oxygenSaturation", "spo2", "pulse"),
    "SLEEP_HOURS": ("sleepHours",),
}
LIMITS = {
    "systolic": (40, 300), "diastolic": (20, 200), "pulse": (20, 250), "glucose": (10, 1000), "heartRate": (20, 300),
    "oxygenSaturation": (1, 100), "sleepHours": (0, 24),
}
GLUCOSE_MMOL, MMOL_TENTHS = (0.6, 55.5), 180.182
CHOICES = {
    "bodyPosition": ("SITTING", "STANDING", "LYING_DOWN", "UNKNOWN"),
    "mealStatus": ("FASTING", "POST_MEAL", "RANDOM", "UNKNOWN"),
    "context": ("RESTING", "ACTIVE", "SLEEPING", "UNKNOWN"),
}
NUMBER = r"^(?:TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


class _Payload:
    """The fields of a JSON object, with their kinds."""

    def __init__(self, json: Column):
        self.whole, self.keys = F.try_parse_json(json), F.json_object_keys(json)

    def has(self, field: str) -> Column:
        return F.coalesce(F.array_contains(self.keys, field), F.lit(False))

    def _kind(self, field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(self.whole, f"$.{field}", "variant"))

    def null(self, field: str) -> Column:
        return ~self.has(field) | F.coalesce(self._kind(field) == "VOID", F.lit(True))

    def number(self, field: str) -> Column:
        """A JSON number; texts that look like one are none."""
        return F.when(self._kind(field).rlike(NUMBER), F.try_variant_get(self.whole, f"$.{field}", "double"))

    def text(self, field: str) -> Column:
        return F.when(self._kind(field) == "STRING", F.try_variant_get(self.whole, f"$.{field}", "string"))


def _outside(field: str, value: Column, limits: tuple[float, float]) -> Column:
    low, high = limits
    return F.when(value.isNull(), f"{field} must be a finite number.").when(
        ~value.between(low, high), f"{field} is outside the supported measurement range."
    )


def _choice(p: _Payload, field: str, required: bool) -> tuple[Column, Column]:
    """A refusal and the canonical value of a choice; one that isn't there is UNKNOWN, or stays away if not required."""
    told = F.upper(F.trim(p.text(field)))
    away = p.null(field) if required else ~p.has(field)
    wrong = F.when(p.text(field).isNull(), f"{field} must be a string.").when(
        ~told.isin(*CHOICES[field]), f"{field} must be one of: {', '.join(CHOICES[field])}."
    )
    return F.when(~away, wrong), F.when(~away, told).when(F.lit(required), F.lit("UNKNOWN"))


def normalized(metric: Column, payload: Column, unit: Column) -> Column:
    """(error, value, unit) of a metric's JSON payload: why it is refused, or its canonical JSON and unit.

    Of several reasons the first counts: an unsupported metric, no object, unexpected fields, the unit, then the fields
    in their order. A unit is taken in any case and is the metric's own where blank. Glucose in mmol/L becomes mg/dL with
    one decimal, and spo2 another name for oxygenSaturation.
    """
    p = _Payload(payload)
    asked = F.coalesce(F.nullif(F.trim(unit), F.lit("")), F.lit(None).cast("string"))
    error = F.when(~F.coalesce(metric.isin(*UNITS), F.lit(False)), F.lit("Unsupported health metric type."))
    error = error.when(p.keys.isNull(), F.lit("The payload is no object."))
    for name, fields in FIELDS.items():
        extra = F.filter(p.keys, lambda k: ~k.isin(*fields))
        error = error.when((metric == name) & (F.size(extra) > 0), F.concat(F.lit("Unexpected health metric fields: "), F.array_join(extra, ", "), F.lit(".")))
        known = F.coalesce(F.lower(asked).isin(*[u.lower() for u in UNITS[name]]), F.lit(True))
        error = error.when((metric == name) & ~known, F.concat(F.lit("Unsupported unit '"), asked, F.lit(f"'. Expected {' or '.join(UNITS[name])}.")))

    mmol = F.coalesce(F.lower(asked) == "mmol/l", F.lit(False))
    glucose = p.number("glucose")
    pulse = F.when(p.has("pulse"), _outside("pulse", p.number("pulse"), LIMITS["pulse"]))
    saturation = F.when(p.null("oxygenSaturation"), p.number("spo2")).otherwise(p.number("oxygenSaturation"))
    position, meal, context = _choice(p, "bodyPosition", False), _choice(p, "mealStatus", True), _choice(p, "context", True)
    reasons = {
        "BLOOD_PRESSURE": (
            _outside("systolic", p.number("systolic"), LIMITS["systolic"]),
            _outside("diastolic", p.number("diastolic"), LIMITS["diastolic"]),
            F.when(p.number("systolic") <= p.number("diastolic"), "Systolic pressure must be greater than diastolic pressure."),
            pulse,
            position[0],
        ),
        "BLOOD_GLUCOSE": (F.when(mmol, _outside("glucose", glucose, GLUCOSE_MMOL)).otherwise(_outside("glucose", glucose, LIMITS["glucose"])), meal[0]),
        "HEART_RATE": (_outside("heartRate", p.number("heartRate"), LIMITS["heartRate"]), context[0]),
        "OXYGEN_SATURATION": (_outside("oxygenSaturation", saturation, LIMITS["oxygenSaturation"]), pulse),
        "SLEEP_HOURS": (_outside("sleepHours", p.number("sleepHours"), LIMITS["sleepHours"]),),
    }
    values = {
        "BLOOD_PRESSURE": (p.number("systolic").alias("systolic"), p.number("diastolic").alias("diastolic"), p.number("pulse").alias("pulse"), position[1].alias("bodyPosition")),
        "BLOOD_GLUCOSE": (F.when(mmol, F.floor(glucose * MMOL_TENTHS + 0.5) / 10).otherwise(glucose).alias("glucose"), meal[1].alias("mealStatus")),
        "HEART_RATE": (p.number("heartRate").alias("heartRate"), context[1].alias("context")),
        "OXYGEN_SATURATION": (saturation.alias("oxygenSaturation"), p.number("pulse").alias("pulse")),
        "SLEEP_HOURS": (p.number("sleepHours").alias("sleepHours"),),
    }
    told, stored = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in UNITS:
        reason = F.coalesce(*reasons[name], F.lit(None).cast("string"))
        told = F.when(metric == name, reason).otherwise(told)
        stored = F.when(metric == name, F.to_json(F.struct(*values[name]))).otherwise(stored)
    error = F.coalesce(error, told)
    own = F.create_map(*[F.lit(x) for name, units in UNITS.items() for x in (name, units[0])])[metric]
    good = error.isNull()
    return F.struct(error.alias("error"), F.when(good, stored).alias("value"), F.when(good, own).alias("unit"))
