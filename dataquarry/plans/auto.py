"""From a table to the analysis it calls for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquarry.operators.clean import apply_cleaning_plan, clean_table
from dataquarry.operators.columns import resolve
from dataquarry.operators.ordered import running_totals
from dataquarry.operators.profile import infer_semantic_type, profile_table
from dataquarry.operators.route import (
    SUPERVISED,
    UNSUPERVISED,
    first_free_text_column,
    infer_task_type,
    route_decision,
)
from dataquarry.plans.clustering import ClusterResult, run_clustering
from dataquarry.plans.report import cluster_report, supervised_report, topic_report
from dataquarry.plans.supervised import SupervisedResult, run_supervised
from dataquarry.plans.topics import TopicResult, run_topics
from dataquarry.runtime import spread
from dataquarry.sources.phases import Phases


@dataclass
class AutoPlan:
    """What is known of a table before its analysis, and the analysis itself."""

    route: str
    reason: str
    profile: DataFrame
    analyse: Callable[[], SupervisedResult | ClusterResult | TopicResult]


@dataclass
class AutoResult:
    route: str
    reason: str
    profile: DataFrame
    result: SupervisedResult | ClusterResult | TopicResult

    def report(self) -> DataFrame:
        if isinstance(self.result, SupervisedResult):
            return supervised_report(self.result)
        if isinstance(self.result, ClusterResult):
            return cluster_report(self.result)
        return topic_report(self.result)


def number_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows numbered from 0 in the order of a digest of their values; only equal rows may change places."""
    cells = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    marked = df.select("*", F.sha2(cells, 256).alias("__digest__"), F.lit(1).cast("long").alias("__one__"))
    return running_totals(marked, ["__digest__"], {key: "__one__"}, "numbered").drop("__digest__", "__one__")


def plan_auto(
    df: DataFrame,
    key: str | None = None,
    target: str | None = None,
    assume_last: bool = False,
    plan: list[tuple[str, str]] | None = None,
    phases: Phases | None = None,
    **options,
) -> AutoPlan:
    """Profile and clean, and choose the route; ``analyse()`` of the result runs it.

    The arguments are those of ``run_auto``.  Profile and route need no model, so that
    they are at hand for tables whose analysis is dear or refused.
    """
    if key is not None:
        key = resolve(df, key)
    data = df if key is None else df.drop(key)
    if target is None and assume_last:
        target = data.columns[-1]
    phases = phases or Phases()
    own, key = key, key or "__row__"

    def clean() -> dict:
        rows = apply_cleaning_plan(df, plan) if plan else clean_table(df)
        return {"rows": rows if own else number_rows(rows, key), "profile": profile_table(df)}

    phase = phases.step("clean", clean)
    cleaned = phase["rows"]
    features = cleaned.drop(key)
    decision = route_decision(features, target).first()
    route = decision["route"]

    def analyse() -> SupervisedResult | ClusterResult | TopicResult:
        if route == SUPERVISED:
            task = infer_task_type(features, target).first()["task"]
            return run_supervised(cleaned, key, target, task, phases=phases, **options)
        if route == UNSUPERVISED:
            return run_clustering(cleaned, key, phases=phases, **options)
        text = first_free_text_column(infer_semantic_type(features)).first()["column"]
        return run_topics(spread(cleaned), key, text, target=target, phases=phases, **options)

    return AutoPlan(route, decision["reason"], phase["profile"], analyse)


def run_auto(
    df: DataFrame,
    key: str | None = None,
    target: str | None = None,
    assume_last: bool = False,
    plan: list[tuple[str, str]] | None = None,
    phases: Phases | None = None,
    **options,
) -> AutoResult:
    """Clean, choose the route, and run it.

    ``key`` names a unique column that identifies rows and is no feature; without
    one, rows are numbered in the order of a digest of their values, whatever files they came in.
    The result also holds the profile of the table as it was read.  ``phases`` publishes every
    phase, those of the chosen analysis included.
    """
    chosen = plan_auto(df, key, target, assume_last, plan, phases, **options)
    return AutoResult(chosen.route, chosen.reason, chosen.profile, chosen.analyse())
