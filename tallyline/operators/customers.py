"""Customer revenue and recency/frequency/monetary segmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import whole_days
from ..functions.labels import SEGMENT_ORDER, customer_segment, segment_position
from ..functions.money import double, exact, mean, ratio, total
from ..functions.ranks import exact_quantiles, range_slices, rows_at_positions
from ..schema import CUSTOMER, known, require
from ..session import cut_lineage
from .profiling import histogram

_QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def per_customer(df: DataFrame) -> DataFrame:
    """Sums, orders and last order per customer, computed once: the table and the segmentation both start here.

    ``df`` may hold lines or sums of lines per order. The group without a complete customer key is still in it,
    because the last order of all may be there.
    """
    require(df, *CUSTOMER, "Order_ID")
    sums = {"Sales": "s", "Profit": "p", "Quantity": "q"}
    parts = [total(exact(df, c)).alias(short) for c, short in sums.items() if c in df.columns]
    parts.append(F.count_distinct("Order_ID").alias("orders"))
    if "Order_Date" in df.columns:
        parts.append(F.max("Order_Date").cast("timestamp_ntz").alias("last_order"))
    return cut_lineage(df.groupBy(*CUSTOMER).agg(*parts))


def customer_revenue_table(df: DataFrame) -> DataFrame:
    """One row per customer, largest revenue first."""
    require(df, *CUSTOMER, "Order_ID", "Sales", "Profit", "Quantity")
    return revenue_of(per_customer(df.select(*CUSTOMER, "Order_ID", "Sales", "Profit", "Quantity")))


def revenue_of(customers: DataFrame) -> DataFrame:
    return (
        known(customers, *CUSTOMER)
        .select(
            *CUSTOMER,
            double("s").alias("Total_Sales"),
            double("p").alias("Total_Profit"),
            F.col("orders").alias("Total_Orders"),
            double("q").alias("Total_Quantity"),
            ratio("p", "s").alias("Profit_Margin"),
            ratio("s", "orders").alias("Avg_Order_Value"),
        )
        .orderBy(F.desc("Total_Sales"), *CUSTOMER)
    )


def rfm_base(df: DataFrame) -> DataFrame:
    """Recency (whole days to one day after the last order of all), frequency and revenue per customer."""
    require(df, *CUSTOMER, "Order_ID", "Order_Date", "Sales")
    return rfm_base_of(per_customer(df.select(*CUSTOMER, "Order_ID", "Order_Date", "Sales")))


def rfm_base_of(customers: DataFrame) -> DataFrame:
    snapshot = customers.agg(F.max("last_order") + F.expr("INTERVAL 1 DAY")).scalar()
    return known(customers, *CUSTOMER).select(
        *CUSTOMER,
        whole_days(F.col("last_order"), snapshot).alias("Recency"),
        F.col("orders").alias("Frequency"),
        double("s").alias("Monetary"),
    )


def _above(thresholds: Sequence[Column], value: Column) -> Column:
    """1 + the number of thresholds lying strictly below the value."""
    score = F.lit(1)
    for threshold in thresholds:
        score = score + (value > threshold).cast("int")
    return score


def _rank_thresholds(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """The rows after which the second, third and fourth quarter of the ranked customers begin."""

    def quarter_ends(size: Column) -> Column:
        last = size - 1
        return F.array(*[((last * k - F.pmod(last * k, F.lit(4))) / 4).cast("long") for k in (1, 2, 3)])

    ranked = df.select(F.lit(0).alias("all"), *order, F.lit(1).cast("long").alias("freq"))
    sliced = range_slices(ranked, "all", order)
    found = rows_at_positions(sliced, "all", order, "freq", lambda size: F.array_distinct(quarter_ends(size)))
    rows = {row["position"]: row for row in found.collect()}  # at most three rows
    last = next(iter(rows.values()))["group_size"] - 1
    types = dict(df.dtypes)
    return [F.struct(*[F.lit(rows[k * last // 4][c]).cast(types[c]).alias(c) for c in order]) for k in (1, 2, 3)]


def quartile_scores(df: DataFrame, measures: Sequence[str], ties_by: Sequence[str]) -> dict[str, Column]:
    """For each measure a 1..4 score column: 1 for the lowest quarter, edges closed on the right.

    The edges are the exact interpolated quartiles. Where two of the five edges coincide, customers are
    ranked instead (equal values by ``ties_by``) and the ranks are cut the same way. Five edges per
    measure come to the driver; the customers themselves do not.
    """
    edges = {
        row["metric"]: row["quantiles"]
        for row in exact_quantiles(df, measures, _QUARTILES).collect()
    }
    scores = {}
    for measure in measures:
        cuts = edges.get(measure)
        if cuts is None:
            raise ValueError(f"no value of {measure} to score")
        if all(low < high for low, high in zip(cuts, cuts[1:], strict=False)):
            scores[measure] = _above([F.lit(cut) for cut in cuts[1:4]], F.col(measure).cast("double"))
        else:
            order = [measure, *ties_by]
            scores[measure] = _above(_rank_thresholds(df, order), F.struct(*order))
    return scores


def score_rfm(base: DataFrame) -> DataFrame:
    """Add quartile scores (4 is best), their sum and the segment to an RFM base."""
    if len(base.head(2)) < 2:
        raise ValueError("quartile scores need at least two customers")
    score = quartile_scores(base, ["Recency", "Frequency", "Monetary"], CUSTOMER)
    scored = base.withColumns(
        {
            # Few days since the last order is good.
            "R_Score": (F.lit(5) - score["Recency"]).cast("int"),
            "F_Score": score["Frequency"].cast("int"),
            "M_Score": score["Monetary"].cast("int"),
        }
    )
    scored = scored.withColumn("RFM_Score", F.col("R_Score") + F.col("F_Score") + F.col("M_Score"))
    return scored.withColumn("RFM_Segment", customer_segment(F.col("RFM_Score")))


def compute_rfm(df: DataFrame) -> DataFrame:
    """One scored and labelled row per customer, largest revenue first."""
    return rfm_of(rfm_base(df))


def rfm_of(base: DataFrame) -> DataFrame:
    return score_rfm(base).orderBy(F.desc("Monetary"), *CUSTOMER)


def segment_counts(rfm: DataFrame) -> DataFrame:
    """Customers per segment, best segment first."""
    counts = rfm.groupBy(F.col("RFM_Segment").alias("Segment")).agg(F.count("*").alias("Count"))
    return counts.orderBy(segment_position(F.col("Segment")))


def segment_revenue(rfm: DataFrame) -> DataFrame:
    sums = rfm.groupBy("RFM_Segment").agg(double(total(exact(rfm, "Monetary"))).alias("Monetary"))
    return sums.orderBy(F.desc("Monetary"), "RFM_Segment")


def top_customers(customers: DataFrame, n: int = 15, by: str = "Total_Sales") -> DataFrame:
    return customers.orderBy(F.desc(by), *CUSTOMER).limit(n)


def customer_kpis(customers: DataFrame, rfm: DataFrame) -> DataFrame:
    """One row of headline figures over the customer table and its segmentation."""
    from_table = customers.agg(
        F.count("*").alias("customers"),
        mean(exact(customers, "Total_Sales")).alias("avg_revenue"),
        F.coalesce(F.max("Total_Sales"), F.lit(0.0)).alias("top_revenue"),
        F.avg("Total_Orders").alias("avg_orders"),
    )
    from_rfm = rfm.agg(
        F.count_if(F.col("RFM_Segment") == SEGMENT_ORDER[0]).alias("champions"),
        F.count_if(F.col("RFM_Segment") == "At Risk").alias("at_risk"),
    )
    return from_table.select(
        "customers",
        "avg_revenue",
        "top_revenue",
        from_rfm.select("champions").scalar().alias("champions"),
        from_rfm.select("at_risk").scalar().alias("at_risk"),
        "avg_orders",
    )


def revenue_histogram(customers: DataFrame, bins: int = 40) -> DataFrame:
    """Range and counts are two passes, so the revenues are computed once before them."""
    return histogram(cut_lineage(customers.select("Total_Sales")), "Total_Sales", bins)


def score_histogram(rfm: DataFrame) -> DataFrame:
    return rfm.groupBy("RFM_Score").agg(F.count("*").alias("Count")).orderBy("RFM_Score")


def scatter_feed(rfm: DataFrame) -> DataFrame:
    return rfm.select("Customer_ID", "Frequency", "Monetary", "Recency")
