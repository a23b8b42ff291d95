"""Compliance rules as a bit mask for each work, their cohorts and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AS_OF = "2026-09-25"
# Rules by bit, and the masks of cohorts.
RULES = ["COMP-01", "COMP-02", "COMP-03", "COMP-04", "MON-01", "RISK-01", "RISK-02", "RISK-03"]
COHORTS = {"policy": 15, "reconciliation": 8, "execution": 240}
SANCTION_DAYS, LEAST_AMOUNT, DURATION_DAYS, MONITOR_DAYS, RISK_DAYS, UTILISATION = 45, 250_000, 365, 90, 180, 0.80


def rule_inputs(works: DataFrame, by_work: DataFrame, late: DataFrame, key: str = "work_id") -> DataFrame:
    """Works with what the rules need: payments by work (success_amount, last_expenditure_date) and late payments (late_payments), where there are any."""
    paid = by_work.select(key, F.col("success_amount").alias("disbursed"), F.col("last_expenditure_date").alias("last_payment_date"))
    return works.withColumn("is_completed", F.col("in_completed")).join(paid, key, "left").join(late.select(key, "late_payments"), key, "left")


def predicates(as_of: str = AS_OF) -> list[Column]:
    """The eight rules in bit order, never null.

    Columns: recommended_date, sanction_date, completion_date, last_payment_date (dates), sanction_amount, disbursed,
    is_completed, late_payments (a count).
    """
    c, now = F.col, F.lit(as_of).cast("date")
    done = F.coalesce(c("is_completed"), F.lit(False))
    paid = F.coalesce(c("disbursed"), F.lit(0))
    since = F.datediff(now, c("sanction_date"))
    end = F.when(done, F.coalesce(c("completion_date"), now)).otherwise(now)
    share = F.coalesce(paid.cast("double") / F.nullif(c("sanction_amount").cast("double"), F.lit(0.0)), F.lit(None).cast("double"))
    sound = lambda x: F.coalesce(x, F.lit(False))
    return [
        sound(F.datediff(c("sanction_date"), c("recommended_date")) > SANCTION_DAYS),
        F.coalesce(c("sanction_amount"), F.lit(0)) < LEAST_AMOUNT,
        sound(F.datediff(end, c("sanction_date")) > DURATION_DAYS),
        done & (paid <= 0),
        sound(~done & (paid <= 0) & (since > MONITOR_DAYS) & (since <= RISK_DAYS)),
        sound(~done & (paid <= 0) & (since > RISK_DAYS)),
        sound(~done & (paid > 0) & (share < UTILISATION) & (F.datediff(now, c("last_payment_date")) > RISK_DAYS)),
        F.coalesce(c("late_payments"), F.lit(0)) >= 1,
    ]


def rule_mask(works: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """``works`` with ``rule_mask``."""
    bits = [F.when(p, F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(predicates(as_of))]
    return works.withColumn("rule_mask", reduce(lambda a, b: a.bitwiseOR(b), bits))


def mask_to_rules(mask: Column) -> Column:
    """The rule ids of a mask, in bit order."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(r)) for i, r in enumerate(RULES)]))


def rules_to_mask(rules: Column) -> Column:
    """The mask of an array of rule ids; unknown ones count for nothing."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.array_contains(rules, r), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)])


def in_cohort(name: str) -> Column:
    """Whether a mask is of a cohort; 'unflagged' is that of no rule."""
    return F.col("rule_mask") == 0 if name == "unflagged" else F.col("rule_mask").bitwiseAND(F.lit(COHORTS[name])) != 0


def rule_breakdown(masked: DataFrame) -> DataFrame:
    """(rule, works, share) for each rule: the works it fires on, and their percentage of all."""
    one = masked.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("rule_mask").bitwiseAND(F.lit(1 << i)) != 0).alias(r) for i, r in enumerate(RULES)])
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("works")) for r in RULES])
    return one.select("total", F.explode(each).alias("x")).select("x.rule", "x.works", F.round(F.col("x.works") * 100.0 / F.nullif("total", F.lit(0)), 2).alias("share"))


def compliance_summary(masked: DataFrame, amount: str = "sanction_amount") -> DataFrame:
    """One row: works, flagged and not, triggers, works by cohort, and outlays in units of 1e7."""
    flagged = F.col("rule_mask") != 0
    outlay = lambda w: F.round(F.coalesce(F.sum(F.when(w, F.col(amount).cast("decimal(18,2)"))), F.lit(0)).cast("double") / 1e7, 2)
    return masked.agg(
        F.count(F.lit(1)).alias("works"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(~flagged).alias("unflagged"),
        F.coalesce(F.sum(F.bit_count("rule_mask")), F.lit(0)).alias("triggers"),
        *[F.count_if(in_cohort(n)).alias(f"{n}_works") for n in COHORTS],
        outlay(F.lit(True)).alias("outlay"),
        outlay(flagged).alias("flagged_outlay"),
    )


def trigger_density(masked: DataFrame) -> DataFrame:
    """(rules fired, works)."""
    return masked.groupBy(F.bit_count("rule_mask").alias("rules_fired")).agg(F.count(F.lit(1)).alias("works"))


def queue(masked: DataFrame, rule: str | None = None, cohort: str | None = None, state: str | None = None, category: str | None = None, search: str | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """Flagged works by rule, cohort, state (any case), category, and a text looked for in ``fields`` (any case). An unknown rule gives none."""
    df = masked.where("rule_mask <> 0")
    if rule is not None:
        df = df.where(F.col("rule_mask").bitwiseAND(F.lit(1 << RULES.index(rule))) != 0) if rule in RULES else df.where(F.lit(False))
    if cohort:
        df = df.where(in_cohort(cohort))
    if state:
        df = df.where(F.lower("state") == state.lower())
    if category:
        df = df.where(F.col("work_category") == category)
    if search:
        df = df.where(reduce(lambda a, b: a | b, [F.lower(F.col(f).cast("string")).contains(search.lower()) for f in fields]))
    return df


def explain(mask: Column) -> Column:
    """The rules of a mask in words, for the page that is shown."""
    words = {
        "COMP-01": f"sanctioned more than {SANCTION_DAYS} days after the recommendation",
        "COMP-02": f"sanctioned amount below {LEAST_AMOUNT:,}",
        "COMP-03": f"open or under way for more than {DURATION_DAYS} days",
        "COMP-04": "completed without a payment",
        "MON-01": f"no payment {MONITOR_DAYS + 1} to {RISK_DAYS} days after the sanction",
        "RISK-01": f"no payment more than {RISK_DAYS} days after the sanction",
        "RISK-02": f"under {UTILISATION:.0%} used and no payment for more than {RISK_DAYS} days",
        "RISK-03": "paid more than 30 days after completion",
    }
    return F.array_join(F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(f"{r}: {words[r]}")) for i, r in enumerate(RULES)])), "; ")
