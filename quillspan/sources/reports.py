"""Small results as Markdown and JSON; what is collected are aggregates, never rows of the input."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import anomaly, features, profile
from quillspan.plans.contracts import SOURCES

MOST = 1000


def _rows(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds {most} rows at most")
    return rows


def markdown(df: DataFrame, title: str, most: int = MOST) -> str:
    """A titled table."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in _rows(df, most)]) + "\n"


def summary(tables: dict[str, DataFrame], most: int = MOST) -> str:
    """JSON of several small results by name."""
    return json.dumps({name: [r.asDict(recursive=True) for r in _rows(df, most)] for name, df in tables.items()}, default=str, indent=1, sort_keys=True)


def quality_report(outputs: dict[str, DataFrame], samples: int = 20) -> str:
    """What a build found: rows by output, containment, presence, conflicts, repeats, checks, and the first rows that were set aside."""
    counts = [f"| {name} | {df.count():,} |" for name, df in sorted(outputs.items()) if name not in ("containment", "conflicts", "checks")]
    parts = ["# Data quality", "", "| Output | Rows |", "|---|---|", *counts, ""]
    parts += [markdown(outputs[n], t) for n, t in (("containment", "Containment of keys"), ("conflicts", "Fields in which sources disagree"), ("checks", "Checks across fields")) if n in outputs]
    if "work_id_duplicates" in outputs:
        parts.append(markdown(outputs["work_id_duplicates"].groupBy("source", "relation").agg(F.count(F.lit(1)).alias("rows")).orderBy("source", "relation"), "Rows of a repeated key"))
    for name, title in (("malformed_ids", "Keys that can't be read"), ("unkeyed_recommendations", "Rows without a key"), ("summary_rows", "Totals rows")):
        if name in outputs:
            parts.append(markdown(outputs[name].orderBy("source", "source_row").limit(samples), f"{title}, the first {samples}"))
    return "\n".join(parts)


def data_dictionary(outputs: dict[str, DataFrame]) -> str:
    """Columns and types of the raw sources and of every output."""
    lines = ["# Data dictionary", ""]
    for source in SOURCES.values():
        lines += [f"## Source {source.name}", "", "| Column | Kind | Required |", "|---|---|---|"]
        lines += [f"| {c} | {k} | {'yes' if c in source.required else ''} |" for c, k in source.columns.items()] + [""]
    for name, df in sorted(outputs.items()):
        lines += [f"## {name}", "", "| Column | Type |", "|---|---|", *[f"| {c} | {t} |" for c, t in df.dtypes], ""]
    lines += ["## Features", "", "| Feature | Group | Timing |", "|---|---|---|", *[f"| {f.name} | {f.group} | {f.timing} |" for f in features.registry()], ""]
    return "\n".join(lines)


def profiling_report(works: DataFrame, columns: list[str], groupings: dict[str, list[str]] | None = None) -> str:
    """Numeric profiles, suitability and the viability of peer groups."""
    numbers = profile.numeric_profile(works, columns)
    parts = ["# Profile of features", "", markdown(numbers, "Numbers"), markdown(profile.suitability(numbers), "Suitability")]
    parts += [markdown(profile.peer_viability(works, c), f"Peers by {name}") for name, c in (groupings or features.PEERS).items()]
    return "\n".join(parts)


def engine_report(scored: DataFrame) -> str:
    """Weights and limits of the scoring rules, and how the scores came out."""
    rules = ["# Review scores", "", "| Signal | Weight |", "|---|---|", *[f"| {n} | {w} |" for n, w in anomaly.WEIGHTS.items()], "", *[f"* {name}: from {floor}" for floor, name in anomaly.LABELS], ""]
    parts = [markdown(anomaly.label_counts(scored), "Labels"), markdown(anomaly.score_bands(scored).orderBy("band"), "Bands of ten"), markdown(anomaly.signal_activation(scored).orderBy("signal"), "Signals by severity"), markdown(anomaly.signals_per_work(scored).orderBy("signals"), "Signals of a work"), markdown(anomaly.top_candidates(scored).select("work_id", "review_priority_score", "explanation_text"), "Highest scores")]
    return "\n".join([*rules, *parts])
