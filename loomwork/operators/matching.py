"""Rule-table matching: by range, by best combination, and by lookup with fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.shared import small


def calorie_match(rows: DataFrame, targets: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """targets (target_id, kcal) with rows (ord, id, calories) within the tolerance, nearest first; the
    nearest row where none is.

    Each target meets the rows once, with the targets broadcast; only targets without a match, found
    by an anti-join, meet them again, in an aggregate that keeps one row a target."""
    t = small(targets)
    gap = F.abs(F.col("calories") - F.col("kcal"))
    inside = F.col("calories").between(F.col("kcal") * (1 - tolerance), F.col("kcal") * (1 + tolerance))
    near = rows.join(t, inside).select("target_id", "ord", "id", "calories", gap.alias("gap"))
    missing = targets.join(near.select("target_id").distinct(), "target_id", "left_anti")
    best = rows.join(small(missing)).groupBy("target_id").agg(F.min(F.struct(gap.alias("gap"), F.col("ord"), F.col("id"), F.col("calories"))).alias("b"))
    return near.withColumn("in_range", F.lit(True)).unionByName(best.select("target_id", "b.ord", "b.id", "b.calories", "b.gap").withColumn("in_range", F.lit(False)))


def target_macros(kcal: Column, carbs: Column, protein: Column, fat: Column) -> list[Column]:
    return [(kcal * protein / 4).alias("t_protein"), (kcal * carbs / 4).alias("t_carbs"), (kcal * fat / 9).alias("t_fat")]


def meal_plans(recipes: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target the breakfast and two meals whose totals are nearest, and their score.

    targets: target_id, kcal, carbs, protein, fat (shares). recipes is a rule table, so all its
    combinations (breakfasts times meals squared) are a bounded table too; the best of each target is an
    aggregate over it. Targets of equal numbers are planned once. A target with a zero share has no plan. Ties go to the earlier rows."""
    numbers = ("calories", "protein_g", "carbs_g", "fat_g")
    side = lambda r, p: r.select(F.col("ord").alias(f"{p}_ord"), F.col("id").alias(p), *(F.col(n).alias(f"{p}_{n}") for n in numbers))
    breakfast, meal = recipes.filter("meal_type = 'breakfast'"), recipes.filter("meal_type = 'meal'")
    combos = side(breakfast, "breakfast").join(small(side(meal, "lunch"))).join(small(side(meal, "dinner")))
    total = {n: F.col(f"breakfast_{n}") + F.col(f"lunch_{n}") + F.col(f"dinner_{n}") for n in numbers}
    combos = combos.select("breakfast_ord", "lunch_ord", "dinner_ord", "breakfast", "lunch", "dinner", *(c.alias(n) for n, c in total.items()))
    shares = ["kcal", "carbs", "protein", "fat"]
    wanted = targets.select(*shares).distinct().select(*shares, *target_macros(*map(F.col, shares)))
    pairs = (("calories", "kcal"), ("protein_g", "t_protein"), ("carbs_g", "t_carbs"), ("fat_g", "t_fat"))
    error = [F.try_divide(F.abs(F.col(n) - F.col(t)), F.col(t)) for n, t in pairs]
    scored = wanted.join(small(combos)).withColumn("score", error[0] + error[1] + error[2] + error[3]).filter("score is not null")
    best = F.min_by(F.struct("breakfast", "lunch", "dinner", *numbers, "score"), F.struct("score", "breakfast_ord", "lunch_ord", "dinner_ord"))
    plans = scored.groupBy(*shares).agg(best.alias("b"))
    return targets.select("target_id", *shares).join(small(plans), shares).select("target_id", "b.*")


def suggestions(plans: DataFrame, recipes: DataFrame) -> DataFrame:
    """target_id, slot, and the recipe of each of a plan's three meals."""
    slots = plans.select("target_id", F.posexplode(F.array("breakfast", "lunch", "dinner")).alias("slot", "id"))
    return slots.join(small(recipes.drop("ord")), "id")


def plan_lookup(plans: DataFrame, exercises: DataFrame) -> DataFrame:
    """id, name, place, exercise (its name, or its id where none is known), sets, reps in plan order."""
    items = plans.select("id", "name", F.posexplode("exercises").alias("place", "x")).select("id", "name", "place", "x.*")
    names = exercises.select(F.col("id").alias("exercise_id"), F.col("name").alias("exercise"))
    return items.join(small(names), "exercise_id", "left").select("id", "name", "place", F.coalesce("exercise", "exercise_id").alias("exercise"), "sets", "reps")


def plan_for(requests: DataFrame, plans: DataFrame) -> DataFrame:
    """request_id, plan_id: the first plan of the asked muscle group, else the first of all."""
    first = plans.groupBy("muscle_group").agg(F.min_by("id", "ord").alias("plan_id"))
    default = plans.agg(F.min_by("id", "ord").alias("default_id"))
    joined = requests.join(F.broadcast(first), "muscle_group", "left").join(F.broadcast(default))
    return joined.select("request_id", F.coalesce("plan_id", "default_id").alias("plan_id"))


def edited(exercises: Column, remove: Column | None = None, append: Column | None = None) -> Column:
    """A plan's exercises without those of an id, and with one more (3 sets of 10) at the end."""
    kept = exercises if remove is None else F.filter(exercises, lambda x: x["exercise_id"] != remove)
    if append is None:
        return kept
    return F.concat(kept, F.array(F.struct(append.alias("exercise_id"), F.lit(3).alias("sets"), F.lit(10).alias("reps"))))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: the profile in use, and last-write-wins upserts."""
    whole = F.max_by(F.struct(*rows.columns), F.struct(order, *[c for c in rows.columns if c not in (key, order)]))
    return rows.groupBy(key).agg(whole.alias("r")).select("r.*")


def top_rows(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("place") <= most)


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming rows of keys that do not exist yet, one for each key."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
