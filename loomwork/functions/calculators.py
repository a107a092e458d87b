"""Closed-form scores with validated input: each gives a struct of ok, errors (field to message) and data.

Errors are values. The first broken rule of a field gives its message, unless the last is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Activity factors, and by goal the calorie factor, protein (g per kg) and fat share.
ACTIVITY = {"sedentary": 1.2, "light": 1.375, "moderate": 1.55, "active": 1.725, "veryActive": 1.9}
GOALS = {"cut": (0.8, 2.2, 0.25), "bulk": (1.1, 1.8, 0.25), "maintain": (1.0, 1.8, 0.25)}
SEXES = ("male", "female")
RANGES = {
    "weightKg": (30, 300), "heightCm": (100, 250), "age": (10, 100), "neckCm": (20, 120), "waistCm": (20, 120), "hipCm": (20, 120),
    "reps": (1, 30), "loadKg": (1, 1000), "bodyFatPct": (2, 60), "calorieFactor": (0.5, 1.5), "proteinPerKg": (0.8, 3.5), "fatRatio": (0.15, 0.4),
}

Rule = tuple[str, Column, str]


def in_range(x: Column, kind: str, whole: bool = False) -> Column:
    """Whether x is a number between the bounds of its kind; false for null and NaN."""
    low, high = RANGES[kind]
    ok = x.isNotNull() & ~F.isnan(x.cast("double")) & x.between(low, high)
    return F.coalesce(ok & (x.cast("double") == F.floor(x)) if whole else ok, F.lit(False))


def ranged(field: str, x: Column, kind: str, whole: bool = False, optional: bool = False) -> Rule:
    low, high = RANGES[kind]
    fine = in_range(x, kind, whole)
    return field, (x.isNull() | fine) if optional else fine, f"{low} to {high}"


def one_of(field: str, x: Column, members: tuple[str, ...]) -> Rule:
    return field, F.coalesce(x.isin(*members), F.lit(False)), "one of " + ", ".join(members)


def validated(rules: list[Rule], data: Column, last_wins: bool = False) -> Column:
    """ok, errors, data; data is null where a rule is broken."""
    order = list(reversed(rules)) if last_wins else rules
    by_field: dict[str, list[Column]] = {}
    for field, fine, message in order:
        by_field.setdefault(field, []).append(F.when(~fine, F.lit(message)))
    entries = [F.when(F.coalesce(*m).isNotNull(), F.struct(F.lit(f).alias("key"), F.coalesce(*m).alias("value"))) for f, m in by_field.items()]
    found = F.filter(F.array(*entries), lambda e: e.isNotNull())
    ok = F.size(found) == 0
    return F.struct(ok.alias("ok"), F.map_from_entries(found).alias("errors"), F.when(ok, data).alias("data"))


def _by(key: Column, values: dict[str, float]) -> Column:
    return F.coalesce(*(F.when(key == k, F.lit(float(v))) for k, v in values.items()))


def bmr(sex: Column, weight: Column, height: Column, age: Column) -> Column:
    rules = [one_of("sex", sex, SEXES), ranged("weightKg", weight, "weightKg"), ranged("heightCm", height, "heightCm"), ranged("age", age, "age", True)]
    value = 10 * weight + 6.25 * height - 5 * age + _by(sex, {"male": 5, "female": -161})
    return validated(rules, F.struct(value.alias("bmr")))


def tdee(base: Column, activity: Column) -> Column:
    rules = [("bmr", F.coalesce((base > 0) & (base < float("inf")), F.lit(False)), "above 0"), one_of("activityLevel", activity, tuple(ACTIVITY))]
    factor = _by(activity, ACTIVITY)
    return validated(rules, F.struct((base * factor).alias("tdee"), factor.alias("factor")))


def body_fat(sex: Column, height: Column, neck: Column, waist: Column, hip: Column) -> Column:
    """Percent of body fat by girths; women need the hip girth, and a hip of 0 counts as none."""
    female = sex == "female"
    has_hip = F.coalesce(hip != 0, F.lit(False))
    rules = [
        one_of("sex", sex, SEXES), ranged("heightCm", height, "heightCm"), ranged("neckCm", neck, "neckCm"), ranged("waistCm", waist, "waistCm"), ranged("hipCm", hip, "hipCm", optional=True),
        ("waistCm", F.coalesce((sex != "male") | (waist > neck), F.lit(True)), "waist above neck"),
        ("hipCm", F.coalesce(~female | has_hip, F.lit(True)), "needed for women"),
        ("waistCm", F.coalesce(~female | ~has_hip | (waist + hip > neck), F.lit(True)), "waist and hip above neck"),
    ]
    h = F.log10(height)
    male_value = 495 / (1.0324 - 0.19077 * F.log10(waist - neck) + 0.15456 * h) - 450
    female_value = 495 / (1.29579 - 0.35004 * F.log10(waist + hip - neck) + 0.221 * h) - 450
    return validated(rules, F.struct(F.when(female, female_value).otherwise(male_value).alias("bodyFatPct")))


def macros(daily: Column, weight: Column, goal: Column, calorie_factor: Column | None = None, protein_per_kg: Column | None = None, fat_ratio: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    given = [none if x is None else x for x in (calorie_factor, protein_per_kg, fat_ratio)]
    kinds = ("calorieFactor", "proteinPerKg", "fatRatio")
    rules = [("tdee", F.coalesce((daily > 0) & (daily < float("inf")), F.lit(False)), "above 0"), ranged("weightKg", weight, "weightKg"), one_of("goal", goal, tuple(GOALS))]
    rules += [ranged(k, x, k, optional=True) for k, x in zip(kinds, given, strict=True)]
    factor, protein, fat = (F.coalesce(x, _by(goal, {g: v[i] for g, v in GOALS.items()})) for i, x in enumerate(given))
    calories, protein_g = daily * factor, protein * weight
    fat_g = calories * fat / 9
    carbs = F.greatest(F.lit(0.0), (calories - protein_g * 4 - fat_g * 9) / 4)
    return validated(rules, F.struct(calories.alias("calories"), protein_g.alias("proteinG"), fat_g.alias("fatG"), carbs.alias("carbsG")))


def ffmi(weight: Column, height: Column, fat_pct: Column) -> Column:
    rules = [ranged("weightKg", weight, "weightKg"), ranged("heightCm", height, "heightCm"), ranged("bodyFatPct", fat_pct, "bodyFatPct")]
    lean, m = weight * (1 - fat_pct / 100), height / 100
    index = F.try_divide(lean, m * m)
    return validated(rules, F.struct(lean.alias("leanMassKg"), index.alias("ffmi"), (index + 6.1 * (1.8 - m)).alias("adjustedFfmi")))


def one_rm(load: Column, reps: Column) -> Column:
    rules = [ranged("weightKg", load, "loadKg"), ranged("reps", reps, "reps", True)]
    return validated(rules, F.struct((load * (1 + reps / 30)).alias("epley"), F.try_divide(36 * load, 37 - reps).alias("brzycki")))
