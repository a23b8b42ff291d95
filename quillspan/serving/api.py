"""The read API: requests as functions over tables, and a small HTTP server around them.

``Reads`` answers from tables that are written once, so a request is a filter, a sorted page or a lookup and never computes a
table anew. Errors are ``serve.NotFound`` (404), ``serve.BadRequest`` (422) and ``serve.Unavailable`` (503).
"""

from __future__ import annotations

import json
from datetime import date
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import anomaly, compliance, duplicates, serve, trends

PAGE, MOST = 25, 200
SORTABLE = ["review_priority_score", "signal_count", "state", "work_category", "sanction_amount", "days_since_sanction", "payment_count_all_rows", "vendor_count", "duplicate_ratio"]


class Reads:
    """Requests over the tables of a build.

    ``tables``: features, and if there are any master, payments (by work), scored, pairs, masked (compliance) and events (trend).
    """

    def __init__(self, tables: dict[str, DataFrame], key: str = "work_id"):
        self.tables, self.key = tables, key

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise serve.Unavailable(f"there is no table {name}")
        return self.tables[name]

    def summary(self) -> dict:
        works = self.table("features")
        out = serve.dashboard(works, paid="success_amount").first().asDict()
        out["by_state"] = serve.rows_of(serve.counts_by(works, "state"))
        out["by_category"] = serve.rows_of(serve.counts_by(works, "work_category"))
        if "scored" in self.tables:
            out["labels"] = serve.rows_of(anomaly.label_counts(self.tables["scored"]))
        return out

    def states(self) -> list[dict]:
        return self._places("state")

    def categories(self) -> list[dict]:
        return self._places("work_category")

    def _places(self, column: str) -> list[dict]:
        works = serve.counts_by(self.table("features"), column)
        if "scored" in self.tables:
            works = works.join(anomaly.candidates_by(self.tables["scored"], column), "value", "left").fillna(0, ["candidates"]).orderBy(F.desc("works"), "value")
        return serve.rows_of(works)

    def anomalies(self, label=(), state=(), work_category=(), min_score=None, max_score=None, sort="-review_priority_score", page=1, page_size=PAGE) -> dict:
        if min_score is not None and max_score is not None and min_score > max_score:
            raise serve.BadRequest("min_score must not exceed max_score")
        rows = serve.where_in(self.table("scored"), {"review_priority_label": label, "state": state, "work_category": work_category})
        rows = serve.where_between(rows, "review_priority_score", min_score, max_score)
        total = rows.count()
        found = serve.page(serve.sort_rows(rows, serve.parse_sort(sort, SORTABLE), self.key), page, page_size, MOST)
        return {"items": serve.rows_of(found), "page": page, "page_size": page_size, "total": total, "pages": -(-total // page_size)}

    def anomaly(self, work: str) -> dict:
        try:
            return serve.lookup(self.table("scored"), self.key, work)
        except serve.NotFound:
            serve.lookup(self.table("features"), self.key, work)  # an unknown work is another matter
            raise serve.NotFound(f"no review record for {work}") from None

    def work(self, work: str) -> dict:
        return serve.work_detail(work, self.table("features"), self.tables.get("master"), self.tables.get("payments"), self.tables.get("scored"), self.key)

    def trends(self, state: str | None = None) -> dict:
        series = trends.trend(self.table("events"), state)
        rows = serve.rows_of(series.orderBy("period"))
        if state and not rows:
            raise serve.NotFound(f"no events of {state}")
        return {"scope": state or "national", "points": rows}

    def duplicates(self, priority=None, batch=False, min_score=None, order="score_desc", page=1, page_size=PAGE) -> dict:
        rows = serve.where_pairs(self.table("pairs"), priority, batch, min_score)
        found = serve.page(serve.sort_pairs(duplicates.explained(rows), order), page, page_size, MOST)
        columns = [c for c in ("cleaned_work_description", "state", "constituency") if c in self.table("features").columns]
        return {"items": serve.rows_of(serve.hydrate(found, self.table("features"), columns, self.key)), "total": rows.count(), "page": page}

    def duplicate_summary(self) -> dict:
        pairs = self.table("pairs")
        out = duplicates.duplicate_summary(pairs).first().asDict()
        return out | {"clusters": duplicates.high_clusters(pairs).count()}

    def compliance(self) -> dict:
        masked = self.table("masked")
        return compliance.compliance_summary(masked).first().asDict() | {"rules": serve.rows_of(compliance.rule_breakdown(masked))}

    def queue(self, rule=None, cohort=None, state=None, category=None, search=None, page=1, page_size=PAGE) -> dict:
        rows = compliance.queue(self.table("masked"), rule, cohort, state, category, search, (self.key, "state", "constituency", "mp_name", "work_description"))
        found = serve.clamped_page(rows, page, page_size, [F.desc("sanction_amount"), self.key])
        return {"items": serve.rows_of(found.withColumn("explanation", compliance.explain(F.col("rule_mask")))), "total": rows.count()}


def _number(text: str, kind):
    try:
        return kind(text)
    except ValueError as e:
        raise serve.BadRequest(f"{text!r} is no number") from e


#: Path to (method of Reads, arguments by kind: lists, numbers, texts).
ROUTES = {
    "summary": ("summary", {}),
    "states": ("states", {}),
    "work-categories": ("categories", {}),
    "anomalies": ("anomalies", {"label": list, "state": list, "work_category": list, "min_score": float, "max_score": float, "sort": str, "page": int, "page_size": int}),
    "trends": ("trends", {"state": str}),
    "duplicates": ("duplicates", {"priority": str, "min_score": float, "order": str, "page": int, "page_size": int}),
    "duplicates/summary": ("duplicate_summary", {}),
    "compliance": ("compliance", {}),
    "compliance/queue": ("queue", {"rule": str, "cohort": str, "state": str, "category": str, "search": str, "page": int, "page_size": int}),
}


def answer(reads: Reads, url: str) -> tuple[int, object]:
    """(status, body) of a GET. Keys of works hold slashes, so what follows anomalies/ or works/ is one key."""
    parts = urlsplit(url)
    path = unquote(parts.path).strip("/").removeprefix("api/v1/")
    try:
        for head, method in (("anomalies/", reads.anomaly), ("works/", reads.work)):
            if path.startswith(head):
                return 200, method(path.removeprefix(head))
        if path not in ROUTES:
            raise serve.NotFound(f"no resource {path}")
        name, kinds = ROUTES[path]
        given = parse_qs(parts.query)
        if odd := set(given) - set(kinds):
            raise serve.BadRequest(f"unknown parameter {', '.join(sorted(odd))}")
        own = {k: v if kinds[k] is list else v[-1] if kinds[k] is str else _number(v[-1], kinds[k]) for k, v in given.items()}
        return 200, getattr(reads, name)(**own)
    except serve.NotFound as e:
        return 404, {"detail": str(e.args[0])}
    except serve.BadRequest as e:
        return 422, {"detail": str(e)}
    except serve.Unavailable as e:
        return 503, {"detail": str(e)}


def plain(value):
    """How JSON writes what it has no type for."""
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, date):
        return value.isoformat()
    return str(value)


def server(reads: Reads, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """An HTTP server for GET requests; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, body = answer(reads, self.path)
            data = json.dumps(body, default=plain).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
