"""Deterministic questions over states: templates as data, answers, scores and summaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrain.functions import text as tx


@dataclass(frozen=True)
class Template:
    """A question: what it needs, how it is answered (an SQL expression over the state) and how it is scored."""

    template_id: str
    tier: str
    kind: str
    target: str
    required: tuple[str, ...]
    answer: str
    method: str
    phrasings: tuple[str, ...]
    tolerance: float | None = None
    options: tuple[str, ...] = ("yes", "no")
    parameters: dict[str, tuple[int, ...]] = field(default_factory=dict)


YES_NO, CHOOSE, NUMBER = ("single_verify", "boolean_match"), ("single_choose", "normalized_match"), ("single_query", "numeric_tolerance")
STRESS = ("baseline", "stress", "amusement", "meditation")


def _yes(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'yes' ELSE 'no' END"


def _t(template_id, target, required, answer, kind, *phrasings, **more) -> Template:
    return Template(template_id, template_id[1].upper(), kind[0], target, required, answer, kind[1], phrasings, **more)


#: Ids, targets, needs, thresholds and tolerances of the questions; the wording is our own.
TEMPLATES = [
    _t("ta1_af_presence_current", "af_presence_current", ("rhythm_class",), _yes("rhythm_class = 'AF'"), YES_NO, "Is there AF in this window?", "Does the present window show AF?"),
    _t("ta2_heart_rate_category_current", "heart_rate_category_current", ("hr_bpm",), "CASE WHEN hr_bpm < 60 THEN 'low' WHEN hr_bpm > 100 THEN 'high' ELSE 'normal' END", CHOOSE, "Is the heart rate low, normal or high?", options=("low", "normal", "high")),
    _t("ta3_heart_rate_query_current", "heart_rate_numeric_current", ("hr_bpm",), "{num:hr_bpm}", NUMBER, "What is the heart rate?", "How many beats per minute now?", tolerance=5.0, options=()),
    _t("ta4_heart_rate_higher_than_previous", "heart_rate_higher_than_previous_window", ("hr_bpm", "previous_hr_bpm"), _yes("hr_bpm - previous_hr_bpm >= 5.0"), YES_NO, "Is the heart rate higher than in the window before?"),
    _t("ta5_rhythm_changed_from_previous", "rhythm_changed_from_previous_window", ("rhythm_class", "previous_rhythm_class"), _yes("rhythm_class <> previous_rhythm_class"), YES_NO, "Has the rhythm changed since the window before?"),
    _t("ta6_stress_presence_current", "stress_presence_current", ("stress_label",), _yes("stress_label = 'stress'"), YES_NO, "Is there stress in this window?"),
    _t("ta7_stress_state_current", "stress_state_current", ("stress_label",), "stress_label", CHOOSE, "Which state is this window in?", options=STRESS),
    _t("ta9_stress_changed_from_previous", "stress_state_changed_from_previous_window", ("stress_label", "previous_stress_label"), _yes("stress_label <> previous_stress_label"), YES_NO, "Has the state changed since the window before?"),
    _t("tb1_af_presence_monitoring_window", "af_presence_monitoring_window", ("af_burden_ratio",), _yes("af_burden_ratio > 0"), YES_NO, "Was there any AF while monitored?"),
    _t("tb2_af_frequency_monitoring_window", "af_frequency_monitoring_window", ("af_burden_ratio",), "CASE WHEN af_burden_ratio = 0 THEN 'not_at_all' WHEN af_burden_ratio < 0.05 THEN 'occasionally' WHEN af_burden_ratio < 0.30 THEN 'often' ELSE 'most_of_the_time' END", CHOOSE, "How often was there AF?", options=("not_at_all", "occasionally", "often", "most_of_the_time")),
    _t("tb3_heart_rate_excursion_threshold_monitoring_window", "heart_rate_excursion_threshold_monitoring_window", ("max_hr_bpm",), _yes("max_hr_bpm > {threshold_bpm}"), YES_NO, "Did the heart rate exceed {threshold_bpm} bpm?", "Any moment above {threshold_bpm} bpm?", parameters={"threshold_bpm": (100, 110, 120, 130)}),
    _t("tb4_highest_heart_rate_query_monitoring_window", "highest_heart_rate_numeric_monitoring_window", ("max_hr_bpm",), "{num:max_hr_bpm}", NUMBER, "What was the highest heart rate?", tolerance=5.0, options=()),
    _t("tb5_rhythm_variability_monitoring_window", "rhythm_variability_monitoring_window", ("rhythm_transition_count_per_hour",), "CASE WHEN rhythm_transition_count_per_hour = 0 THEN 'stable' WHEN rhythm_transition_count_per_hour <= 3 THEN 'occasional_changes' ELSE 'frequent_changes' END", CHOOSE, "How variable was the rhythm?", options=("stable", "occasional_changes", "frequent_changes")),
    _t("tb6_stress_presence_monitoring_window", "stress_presence_monitoring_window", ("stress_burden_ratio",), _yes("stress_burden_ratio > 0"), YES_NO, "Was there any stress while monitored?"),
    _t("tb7_stress_ratio_query_monitoring_window", "stress_ratio_monitoring_window", ("stress_burden_ratio",), "{num:stress_burden_ratio}", NUMBER, "Which share of the time was stress?", tolerance=0.02, options=()),
    _t("tb8_stress_duration_query_monitoring_window", "stress_duration_monitoring_window", ("stress_duration_s",), "{num:(stress_duration_s / 60.0)}", NUMBER, "How many minutes of stress were there?", tolerance=0.1, options=()),
    _t("tb9_dominant_stress_state_monitoring_window", "dominant_stress_state_monitoring_window", ("dominant_stress_label",), "dominant_stress_label", CHOOSE, "Which state dominated?", options=STRESS),
]


def combinations(template: Template) -> list[tuple[str, dict[str, int]]]:
    """(id part, values) of every parameter combination; one empty one without parameters."""
    out: list[tuple[str, dict[str, int]]] = [("", {})]
    for name in sorted(template.parameters):
        out = [(f"{part}__{name}{v}" if part else f"{name}{v}", {**values, name: v}) for part, values in out for v in template.parameters[name]]
    return out


def answer_sql(template: Template, values: dict[str, int], number: str) -> str:
    """The answer as SQL; `number` is the engine's number format with {x}."""
    text = template.answer
    if text.startswith("{num:"):
        return number.replace("{x}", text[5:-1])
    for name, value in values.items():
        text = text.replace(f"{{{name}}}", str(value))
    return text


NUMBER_SQL = "CASE WHEN {x} = floor({x}) THEN cast(cast({x} AS bigint) AS string) ELSE format_string('%.1f', {x}) END"


def select_templates(tier: str | None = None, kind: str | None = None, target: str | None = None) -> list[Template]:
    return [t for t in TEMPLATES if (tier in (None, t.tier)) and (kind in (None, t.kind)) and (target in (None, t.target))]


def generate(states: DataFrame, templates: list[Template] = TEMPLATES, identity: str = "state_id") -> DataFrame:
    """Every state with every template it has the fields for, parameter and phrasing: one scan, one explode."""
    items = []
    for t in templates:
        needed = " AND ".join(f"{c} IS NOT NULL" for c in t.required)
        for part, values in combinations(t):
            answer = F.expr(answer_sql(t, values, NUMBER_SQL)).cast("string")
            asked = [F.lit(p.format(**values)) for p in t.phrasings]
            items.append(F.when(F.expr(needed), F.struct(F.lit(t.template_id).alias("template_id"), F.lit(t.tier).alias("tier"), F.lit(t.kind).alias("kind"), F.lit(t.target).alias("target"), F.lit(part).alias("parameters"), answer.alias("answer"), F.lit(t.method).alias("method"), F.lit(t.tolerance).cast("double").alias("tolerance"), F.array(*asked).alias("phrasings"))))
    rows = states.select(identity, F.explode(F.array_compact(F.array(*items))).alias("q")).select(identity, "q.*")
    asked = rows.select(identity, "template_id", "tier", "kind", "target", "parameters", "answer", "method", "tolerance", F.posexplode("phrasings").alias("phrasing", "question"))
    return asked.withColumn("question_id", tx.question_id(F.col(identity).cast("string"), F.col("template_id"), F.col("parameters"), F.col("phrasing")))


def accuracy(scored: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy over all and by each column; a missing score counts as wrong."""
    sets = [[], *([F.col(c)] for c in by)]
    return scored.groupingSets(sets, *(F.col(c) for c in by)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("score").cast("int"), F.lit(0))).alias("accuracy"))


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent known value; ties go to the one seen first."""
    seen = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_n"), "_first")
    return seen.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, F.col(value).alias("vote"), F.col("_n").alias("votes"))


def compare_previous(states: DataFrame, keys: list[str], order: list[str], numbers: list[str], labels: list[str], identity: str) -> DataFrame:
    """Long form of each state against the one before: delta and direction of numbers, change of labels."""
    w = Window.partitionBy(*keys).orderBy(*order)
    parts = []
    for c in numbers:
        d = F.col(c) - F.lag(c).over(w)
        parts.append(F.struct(F.lit(c).alias("metric"), d.alias("delta"), F.when(d > 0, "up").when(d < 0, "down").when(d == 0, "same").alias("direction"), (F.abs(d) >= 5).alias("changed")))
    for c in labels:
        parts.append(F.struct(F.lit(c).alias("metric"), F.lit(None).cast("double").alias("delta"), F.lit(None).cast("string").alias("direction"), (F.col(c) != F.lag(c).over(w)).alias("changed")))
    return states.select(identity, F.array(*parts).alias("_p")).select(identity, F.explode("_p").alias("p")).select(identity, "p.*")


def routing(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Counts of fixed categories, zeros kept."""
    counts = df.agg(*(F.count_if(F.col(column) == c).alias(c) for c in categories))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in categories))).alias("x")).select("x.*")
