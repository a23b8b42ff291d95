"""Contracts of the six raw sources and of the tables built from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """A raw table: columns by kind ('text', 'key', 'date', 'amount'), and what totals rows are told by."""

    name: str
    columns: dict[str, str]
    amount: str
    labels: list[str]
    identity: list[str]
    key: str | None = None
    bare_key: bool = False
    no_numbers: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    aliases: dict[str, list[str]] = field(default_factory=dict)


_PLACE = ["state", "ida", "mp_name", "constituency"]


def _work(name: str, extra: dict[str, str], amount: str, labels: tuple[str, ...] = ()) -> Source:
    columns = {c: "text" for c in ("work_category", *_PLACE, "work_description")} | {"work": "key"} | extra
    short = ["work_category", *_PLACE, "work", *labels]
    return Source(name, columns, amount, short, ["work_category", *_PLACE, "work_description", "work"], key="work", no_numbers=short, required=["work"])


SOURCES = {
    s.name: s
    for s in (
        _work("recommended", {"recommended_date": "date", "recommended_amount": "amount", "sanction_date": "date"}, "recommended_amount"),
        _work("sanctioned", {"recommended_date": "date", "sanction_date": "date", "sanction_amount": "amount", "work_status": "text"}, "sanction_amount", ("work_status",)),
        _work("completed", {"completion_date": "date", "completed_amount_disbursed": "amount"}, "completed_amount_disbursed"),
        Source(
            "expenditure",
            {c: "text" for c in (*_PLACE, "work", "vendor_name", "payment_status")} | {"work_id": "key", "expenditure_date": "date", "fund_disbursed_amount": "amount"},
            "fund_disbursed_amount",
            [*_PLACE, "work", "vendor_name", "payment_status"],
            [*_PLACE, "work", "vendor_name", "payment_status"],
            key="work_id",
            bare_key=True,
            no_numbers=[*_PLACE, "work", "payment_status"],  # a vendor's name may be a number
            required=["work_id"],
        ),
        Source("allocation", {"state": "text", "mp_name": "text", "constituency": "text", "allocated_amount": "amount"}, "allocated_amount", ["state", "mp_name", "constituency"], ["state", "mp_name", "constituency"], no_numbers=["state", "mp_name", "constituency"]),
        Source("calamity", {"calamity_type": "text", "calamity_name": "text", "mp_name": "text", "consent_date": "date", "consent_amount": "amount"}, "consent_amount", ["calamity_type", "calamity_name", "mp_name"], ["calamity_type", "calamity_name", "mp_name"], no_numbers=["calamity_type", "calamity_name", "mp_name"]),
    )
}


class ContractError(ValueError):
    """A table lacks a column, or a key isn't unique."""


def require_columns(df: DataFrame, columns: list[str], name: str = "input") -> DataFrame:
    """``df``, if it has all the columns."""
    if lost := [c for c in columns if c not in df.columns]:
        raise ContractError(f"{name} lacks the column(s) {', '.join(lost)}")
    return df


def require_unique(df: DataFrame, key: str, name: str = "input") -> DataFrame:
    """``df``, if no key repeats."""
    again = df.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()
    if again:
        raise ContractError(f"{name} repeats {key}: {', '.join(str(r[0]) for r in again)}")
    return df


def bind_columns(df: DataFrame, aliases: dict[str, list[str]], required: list[str] = ()) -> DataFrame:
    """Rename columns that match a canonical name or an alias of it in any case; an absent optional one becomes null, others stay."""
    have = {c.strip().lower(): c for c in reversed(df.columns)}
    out, used = [], set()
    for name, others in aliases.items():
        found = next((have[x.lower()] for x in (name, *others) if x.lower() in have), None)
        if found is None and name in required:
            raise ContractError(f"input lacks the column {name}")
        out.append(F.col(f"`{found}`").alias(name) if found else F.lit(None).cast("string").alias(name))
        used.add(found)
    return df.select(*out, *[F.col(f"`{c}`") for c in df.columns if c not in used and c not in aliases])
