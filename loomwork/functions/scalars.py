"""Small scalar functions: sigmoid, back-off, retry rules, ids, log lines, labels, days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error names and network codes that pass, label texts, field names of secrets.
TRANSIENT = ("TimeoutError", "APIConnectionError", "APIConnectionTimeoutError")
NETWORK = tuple(
    "ECONNRESET ECONNREFUSED ETIMEDOUT EPIPE EHOSTUNREACH ENETUNREACH ENETDOWN EAI_AGAIN ENOTFOUND UND_ERR_CONNECT_TIMEOUT UND_ERR_SOCKET UND_ERR_HEADERS_TIMEOUT UND_ERR_BODY_TIMEOUT".split()
)
LOG_LINES = {
    "bmr": ("BMR %s kcal · TDEE %s kcal", (("bmr", 0), ("tdee", 0))),
    "bodyfat": ("体脂率 %s%%", (("bodyFatPct", 1),)),
    "macros": ("热量 %s kcal · 蛋白 %sg · 碳水 %sg · 脂肪 %sg", (("calories", 0), ("proteinG", 0), ("carbsG", 0), ("fatG", 0))),
    "ffmi": ("FFMI %s · 标准化 %s · 瘦体重 %skg", (("ffmi", 2), ("adjustedFfmi", 2), ("leanMassKg", 1))),
    "onerm": ("1RM %skg (Epley) / %skg (Brzycki)", (("epley", 1), ("brzycki", 1))),
}
BACKENDS = ("deepseek", "claude")
PRESETS = {"cut": (0.4, 0.4, 0.2), "bulk": (0.5, 0.3, 0.2), "balanced": (0.45, 0.3, 0.25)}  # carbs, protein, fat
GROUP_LABELS = {"chest": "胸", "shoulder": "肩", "back": "背", "legs": "腿", "arms": "臂"}
DIFFICULTY_LABELS = {"beginner": "入门", "intermediate": "中级", "advanced": "高级"}
USAGE_FIELDS = {  # fields of a provider's usage that make up prompt and completion tokens
    "deepseek": (("prompt_tokens",), ("completion_tokens",)),
    "claude": (("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"), ("output_tokens",)),
}
REQUEST_ID = "^[A-Za-z0-9_.:-]{1,64}$"


def sigmoid(x: Column) -> Column:
    """Without overflow for large negative x."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def backoff(attempt: Column, base_ms: float, most_ms: float, chance: Column) -> Column:
    """Half of the exponential delay, and `chance` (0 to 1) of the other half."""
    ceiling = F.least(F.lit(float(most_ms)), base_ms * F.pow(F.lit(2.0), attempt))
    return F.floor(ceiling / 2 + chance * ceiling / 2 + 0.5).cast("long")


def retry_after_seconds(ms: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(ms / 1000).cast("int"))


def retryable(name: Column, status: Column, code: Column, has_cause: Column, message: Column) -> Column:
    """An aborted call never; a status only if 429 or 500 and above; else by name, code or a failed fetch."""
    fetch = (name == "TypeError") & (has_cause | F.lower(message).contains("fetch"))
    by_kind = F.coalesce(name.isin(*TRANSIENT), F.lit(False)) | F.coalesce(code.isin(*NETWORK), F.lit(False)) | F.coalesce(fetch, F.lit(False))
    return F.when(name == "AbortError", False).when(status.isNotNull(), (status == 429) | (status >= 500)).otherwise(by_kind)


def backend(mode: Column, keys: dict[str, Column]) -> Column:
    """The asked backend if it has a key, `rule` if it has none or is asked for; else the first with a key."""
    has = {k: F.coalesce(F.trim(v) != "", F.lit(False)) for k, v in keys.items()}
    first = F.coalesce(*(F.when(has[k], F.lit(k)) for k in BACKENDS), F.lit("rule"))
    asked = F.lower(F.trim(mode))
    chosen = F.when(asked == "rule", F.lit("rule"))
    for k in BACKENDS:
        chosen = chosen.when(asked == k, F.when(has[k], F.lit(k)).otherwise(F.lit("rule")))
    return chosen.otherwise(first)


def request_id(value: Column) -> Column:
    """The id if it is clean, else a new one."""
    return F.when(F.coalesce(value.rlike(REQUEST_ID), F.lit(False)), value).otherwise(F.uuid())


def cleaned_request_id(value: Column) -> Column:
    """The id without other characters, 64 at most; null if nothing is left."""
    return F.nullif(F.left(F.regexp_replace(value, "[^A-Za-z0-9_.:-]", ""), F.lit(64)), F.lit(""))


def _fixed(x: Column, digits: int) -> Column:
    """With `digits` decimals, half up on the shortest decimal form of x."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def log_line(kind: Column, raw: Column) -> Column:
    """A one-line form of a logged calculation; raw text for unknown kinds and broken JSON; - for missing numbers."""
    data = F.try_parse_json(raw)
    out = F.when(data.isNull(), raw)
    for name, (template, fields) in LOG_LINES.items():
        shown = [F.coalesce(_fixed(F.try_variant_get(data, f"$.{f}", "double"), d), F.lit("-")) for f, d in fields]
        out = out.when(kind == name, F.format_string(template, *shown))
    return out.otherwise(raw)


def start_of_day(ts: Column, offset_minutes: int) -> Column:
    """The instant at which the day of ts began, `offset_minutes` east of UTC."""
    shift = F.expr(f"make_dt_interval(0, 0, {int(offset_minutes)})")
    return F.date_trunc("day", ts + shift) - shift


def day_key(ts: Column, offset_minutes: int) -> Column:
    return F.date_format(ts + F.expr(f"make_dt_interval(0, 0, {int(offset_minutes)})"), "yyyy-MM-dd")


def ratios(carbs: Column, protein: Column, fat: Column) -> Column:
    """The three as shares of their sum; null unless the sum is above 0."""
    total = carbs + protein + fat
    return F.when(total > 0, F.struct(*(F.try_divide(x, total).alias(n) for n, x in (("carbs", carbs), ("protein", protein), ("fat", fat)))))


def redacted(fields: dict[str, Column], secret: tuple[str, ...]) -> list[Column]:
    """Columns with those of secret names replaced; names are compared without case."""
    hidden = {s.lower() for s in secret}
    return [(F.lit("[REDACTED]") if name.lower() in hidden else x).alias(name) for name, x in fields.items()]


def labelled(value: Column, labels: dict[str, str]) -> Column:
    """The shown text of a code; the code itself where it has none."""
    return F.coalesce(*(F.when(value == k, F.lit(v)) for k, v in labels.items()), value)


def usage_tokens(provider: Column, usage: Column) -> Column:
    """prompt_tokens and completion_tokens of a provider's usage in JSON; 0 for what is missing, null or broken."""
    data = F.try_parse_json(usage)
    field = lambda name: F.coalesce(F.try_variant_get(data, f"$.{name}", "bigint"), F.lit(0).cast("long"))
    total = lambda names: sum((field(n) for n in names[1:]), field(names[0]))
    part = lambda i: F.coalesce(*(F.when(provider == k, total(v[i])) for k, v in USAGE_FIELDS.items()), F.lit(0).cast("long"))
    return F.struct(part(0).alias("prompt_tokens"), part(1).alias("completion_tokens"))
