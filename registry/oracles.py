"""For each registered query the same result as one SQL statement for another engine.

The forest's own figures are left out (another library's forest differs); what must hold for them is in.
"""

from __future__ import annotations

import re

from tallyline.operators import insights as wording

# --- shared parts --------------------------------------------------------------------------------

_PARTS = {
    "order_lines": """
SELECT l_orderkey AS Order_ID, o_orderdate AS Order_Date, l_shipdate AS Ship_Date, o_orderpriority AS Ship_Mode,
       o_custkey AS Customer_ID, c_name AS Customer_Name, c_mktsegment AS Segment, n_name AS State, r_name AS Region,
       p_type AS Category, p_brand AS Sub_Category, l_partkey AS Product_ID, p_name AS Product_Name,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS Sales,
       CAST(l_quantity AS BIGINT) AS Quantity, CAST(l_discount AS DECIMAL(4,2)) AS Discount,
       CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4))
            - 2 * CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(10,0)) AS DECIMAL(18,4)) AS Profit
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey""",
    "f": """
SELECT *, CAST(year(Order_Date) AS INTEGER) AS Year, CAST(month(Order_Date) AS INTEGER) AS Month,
       CAST(quarter(Order_Date) AS INTEGER) AS Quarter, strftime(Order_Date, '%b') AS Month_Name,
       strftime(Order_Date, '%Y-%m') AS Year_Month,
       year(Order_Date) || '-Q' || quarter(Order_Date) AS Year_Quarter,
       CAST(floor((epoch_us(Ship_Date) - epoch_us(Order_Date)) / 86400000000.0) AS INTEGER) AS Days_to_Ship,
       CAST(Profit AS DOUBLE) / NULLIF(CAST(Sales AS DOUBLE), 0) AS Profit_Margin,
       CAST(Sales AS DOUBLE) / NULLIF(CAST(Quantity AS DOUBLE), 0) AS Sales_per_Unit,
       CAST(Profit AS DOUBLE) / NULLIF(CAST(Quantity AS DOUBLE), 0) AS Profit_per_Unit,
       Profit > 0 AS Is_Profitable
FROM order_lines""",
    "null_keys": """
SELECT * REPLACE (CASE WHEN Order_ID % 13 <> 0 THEN Category END AS Category,
                  CASE WHEN Order_ID % 17 <> 0 THEN Region END AS Region)
FROM f""",
    "stress": """
SELECT * REPLACE (CAST(Discount AS DECIMAL(18,8)) AS Discount) FROM f
UNION ALL
SELECT * REPLACE (CAST(Discount * 10 AS DECIMAL(18,8)) AS Discount) FROM f
UNION ALL
SELECT * REPLACE (CAST(Discount * 10 - 0.00004 AS DECIMAL(18,8)) AS Discount) FROM f""",
    "raw": """
SELECT CASE WHEN Order_ID % 7 = 0 THEN '  ' || Order_ID || chr(9) ELSE CAST(Order_ID AS VARCHAR) END AS Order_ID,
       CASE WHEN Order_ID % 101 = 0 THEN 'not-a-date' WHEN Order_ID % 5 = 1 THEN strftime(Order_Date, '%-m/%-d/%Y')
            WHEN Order_ID % 5 = 2 THEN strftime(Order_Date, '%b %-d, %Y')
            ELSE strftime(Order_Date, '%Y-%m-%d') END AS Order_Date,
       CASE WHEN Order_ID % 103 = 0 THEN 'unknown' ELSE strftime(Ship_Date, '%Y-%m-%d') END AS Ship_Date,
       CAST(Customer_ID AS VARCHAR) AS Customer_ID, Region,
       CASE WHEN Order_ID % 53 = 0 THEN NULL WHEN Order_ID % 11 = 0 THEN Category || ' ' || chr(10)
            ELSE Category END AS Category,
       Sub_Category, CAST(Product_ID AS VARCHAR) AS Product_ID,
       CASE WHEN Order_ID % 97 = 0 THEN 'n/a' WHEN Order_ID % 89 = 0 THEN '0' WHEN Order_ID % 83 = 0 THEN ' -5.25 '
            WHEN Order_ID % 29 = 1 THEN '1000000000000000.5' WHEN Order_ID % 23 = 1 THEN CAST(Sales AS VARCHAR) || '1234'
            WHEN Order_ID % 50 = 10 THEN CAST(Sales AS VARCHAR) || CAST(copy + 1 AS VARCHAR)
            ELSE CAST(Sales AS VARCHAR) END AS Sales,
       CASE WHEN Order_ID % 79 = 0 THEN '0' ELSE CAST(Quantity AS VARCHAR) END AS Quantity,
       CASE WHEN Order_ID % 61 = 0 THEN '-0.1' WHEN Order_ID % 59 = 0 THEN '1.5' WHEN Order_ID % 67 = 0 THEN NULL
            WHEN Order_ID % 31 = 0 THEN '0.19996' WHEN Order_ID % 37 = 0 THEN '0.0999999'
            ELSE CAST(Discount AS VARCHAR) END AS Discount,
       CAST(Profit AS VARCHAR) AS Profit,
       CASE WHEN Order_ID % 2 = 0 THEN 'web' ELSE 'store' END AS Channel
FROM order_lines, LATERAL (SELECT unnest(range(CASE WHEN Order_ID % 10 = 0 THEN 2 ELSE 1 END))) AS copies(copy)""",
    "typed": """
SELECT trim_all(Order_ID) AS Order_ID, read_date(Order_Date) AS Order_Date,
       TRY_CAST(trim_all(Ship_Date) AS TIMESTAMP) AS Ship_Date, trim_all(Customer_ID) AS Customer_ID,
       trim_all(Region) AS Region, trim_all(Category) AS Category, trim_all(Sub_Category) AS Sub_Category,
       trim_all(Product_ID) AS Product_ID,
       TRY_CAST(trim_all(Sales) AS DOUBLE) AS Sales, TRY_CAST(trim_all(Quantity) AS DOUBLE) AS Quantity,
       TRY_CAST(trim_all(Discount) AS DOUBLE) AS Discount, TRY_CAST(trim_all(Profit) AS DOUBLE) AS Profit,
       trim_all(Channel) AS Channel
FROM raw""",
    "core": """
SELECT * FROM typed
WHERE Sales IS NOT NULL AND Quantity IS NOT NULL AND Profit IS NOT NULL AND Order_Date IS NOT NULL""",
    "dedup": "SELECT DISTINCT * FROM core",
    "clean": """
SELECT * REPLACE (CASE WHEN Discount < 0 THEN 0 WHEN Discount > 1 THEN 1 ELSE Discount END AS Discount) FROM dedup""",
    "docs": """
SELECT documents.doc_id, lang, source, n_chars, quality, toxic
FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id""",
    "doc_missing": """
SELECT 'doc_id' AS column_name, 'bigint' AS dtype, count(*) - count(doc_id) AS missing_count, count(*) AS n FROM docs
UNION ALL SELECT 'lang', 'string', count(*) - count(lang), count(*) FROM docs
UNION ALL SELECT 'source', 'string', count(*) - count(source), count(*) FROM docs
UNION ALL SELECT 'n_chars', 'bigint', count(*) - count(n_chars), count(*) FROM docs
UNION ALL SELECT 'quality', 'int', count(*) - count(quality), count(*) FROM docs
UNION ALL SELECT 'toxic', 'int', count(*) - count(toxic), count(*) FROM docs""",
    "sub": """
SELECT Category, Sub_Category, CAST(sum(Sales) AS DOUBLE) AS Sales, CAST(sum(Profit) AS DOUBLE) AS Profit,
       CAST(sum(Quantity) AS DOUBLE) AS Quantity,
       CAST(sum(Profit) AS DOUBLE) / NULLIF(CAST(sum(Sales) AS DOUBLE), 0) AS Profit_Margin
FROM f GROUP BY Category, Sub_Category""",
    "cat": """
SELECT Category, CAST(sum(Sales) AS DOUBLE) AS Sales, CAST(sum(Profit) AS DOUBLE) AS Profit,
       count(DISTINCT Order_ID) AS Orders,
       CAST(sum(Profit) AS DOUBLE) / NULLIF(CAST(sum(Sales) AS DOUBLE), 0) AS Profit_Margin
FROM f GROUP BY Category""",
    "reg": """
SELECT Region, CAST(sum(Sales) AS DOUBLE) AS Sales, CAST(sum(Profit) AS DOUBLE) AS Profit,
       count(DISTINCT Order_ID) AS Orders,
       CAST(sum(Profit) AS DOUBLE) / NULLIF(CAST(sum(Sales) AS DOUBLE), 0) AS Profit_Margin
FROM f GROUP BY Region""",
    "cust": """
SELECT Customer_ID, Customer_Name, Segment, CAST(sum(Sales) AS DOUBLE) AS Total_Sales,
       CAST(sum(Profit) AS DOUBLE) AS Total_Profit, count(DISTINCT Order_ID) AS Total_Orders,
       CAST(sum(Quantity) AS DOUBLE) AS Total_Quantity,
       CAST(sum(Profit) AS DOUBLE) / NULLIF(CAST(sum(Sales) AS DOUBLE), 0) AS Profit_Margin,
       CAST(sum(Sales) AS DOUBLE) / count(DISTINCT Order_ID) AS Avg_Order_Value
FROM f GROUP BY Customer_ID, Customer_Name, Segment""",
    "rfm_base": """
SELECT Customer_ID, Customer_Name, Segment,
       CAST(date_diff('day', max(Order_Date), (SELECT max(Order_Date) FROM f) + INTERVAL 1 DAY) AS INTEGER) AS Recency,
       count(DISTINCT Order_ID) AS Frequency, CAST(sum(Sales) AS DOUBLE) AS Monetary
FROM f GROUP BY Customer_ID, Customer_Name, Segment""",
    "rfm_edges": """
SELECT quantile_cont(CAST(Recency AS DOUBLE), [0.25, 0.5, 0.75]) AS r,
       quantile_cont(CAST(Frequency AS DOUBLE), [0.25, 0.5, 0.75]) AS f,
       quantile_cont(Monetary, [0.25, 0.5, 0.75]) AS m FROM rfm_base""",
    "rfm_scores": """
SELECT rfm_base.*,
       4 - CAST(Recency > r[1] AS INTEGER) - CAST(Recency > r[2] AS INTEGER) - CAST(Recency > r[3] AS INTEGER) AS R_Score,
       1 + CAST(Frequency > f[1] AS INTEGER) + CAST(Frequency > f[2] AS INTEGER) + CAST(Frequency > f[3] AS INTEGER)
           AS F_Score,
       1 + CAST(Monetary > m[1] AS INTEGER) + CAST(Monetary > m[2] AS INTEGER) + CAST(Monetary > m[3] AS INTEGER)
           AS M_Score
FROM rfm_base, rfm_edges""",
    "rfm": """
SELECT *, R_Score + F_Score + M_Score AS RFM_Score,
       CASE WHEN R_Score + F_Score + M_Score >= 11 THEN 'Champions' WHEN R_Score + F_Score + M_Score >= 9
            THEN 'Loyal Customers' WHEN R_Score + F_Score + M_Score >= 7 THEN 'Potential Loyalists'
            WHEN R_Score + F_Score + M_Score >= 5 THEN 'At Risk' ELSE 'Lost / Inactive' END AS RFM_Segment
FROM rfm_scores""",
    # Frequencies and recencies with few distinct values: their quartile edges coincide, so ranks are cut.
    "tied_base": """
SELECT * REPLACE (CAST(floor(Recency / 400) AS INTEGER) AS Recency, least(Frequency, 9) AS Frequency) FROM rfm_base""",
    "tied_ranks": """
SELECT *, count(*) OVER () AS n,
       row_number() OVER (ORDER BY Recency, Customer_ID, Customer_Name, Segment) AS rr,
       row_number() OVER (ORDER BY Frequency, Customer_ID, Customer_Name, Segment) AS rf,
       quantile_cont(CAST(Recency AS DOUBLE), [0, 0.25, 0.5, 0.75, 1]) OVER () AS qr,
       quantile_cont(CAST(Frequency AS DOUBLE), [0, 0.25, 0.5, 0.75, 1]) OVER () AS qf,
       quantile_cont(Monetary, [0.25, 0.5, 0.75]) OVER () AS qm
FROM tied_base""",
    "tied_scores": """
SELECT Customer_ID, Customer_Name, Segment, Recency, Frequency, Monetary,
       4 - CASE WHEN qr[1] < qr[2] AND qr[2] < qr[3] AND qr[3] < qr[4] AND qr[4] < qr[5]
                THEN CAST(Recency > qr[2] AS INTEGER) + CAST(Recency > qr[3] AS INTEGER)
                     + CAST(Recency > qr[4] AS INTEGER)
                ELSE CAST(4 * (rr - 1) > n - 1 AS INTEGER) + CAST(4 * (rr - 1) > 2 * (n - 1) AS INTEGER)
                     + CAST(4 * (rr - 1) > 3 * (n - 1) AS INTEGER) END AS R_Score,
       1 + CASE WHEN qf[1] < qf[2] AND qf[2] < qf[3] AND qf[3] < qf[4] AND qf[4] < qf[5]
                THEN CAST(Frequency > qf[2] AS INTEGER) + CAST(Frequency > qf[3] AS INTEGER)
                     + CAST(Frequency > qf[4] AS INTEGER)
                ELSE CAST(4 * (rf - 1) > n - 1 AS INTEGER) + CAST(4 * (rf - 1) > 2 * (n - 1) AS INTEGER)
                     + CAST(4 * (rf - 1) > 3 * (n - 1) AS INTEGER) END AS F_Score,
       1 + CAST(Monetary > qm[1] AS INTEGER) + CAST(Monetary > qm[2] AS INTEGER)
         + CAST(Monetary > qm[3] AS INTEGER) AS M_Score
FROM tied_ranks""",
    "bands": """
SELECT *, CASE WHEN Discount < 0 THEN NULL WHEN Discount < 0.001 THEN '0%' WHEN Discount < 0.1 THEN '1-9%'
               WHEN Discount < 0.2 THEN '10-20%' WHEN Discount < 0.3 THEN '21-30%' WHEN Discount < 0.4 THEN '31-40%'
               WHEN Discount < 0.5 THEN '41-50%' WHEN Discount < 0.6 THEN '51-60%' WHEN Discount < 0.8 THEN '61-80%'
               WHEN Discount < 1.01 THEN '>80%' END AS Discount_Bin
FROM f""",
}
# The dirty rows with the text columns that a whole run needs.
_MORE = ("State", "Segment", "Customer_Name", "Ship_Mode", "Product_Name")
for _part, _source in (("raw", ""), ("typed", "raw"), ("core", "typed"), ("dedup", "core"), ("clean", "dedup")):
    _text = _PARTS[_part]
    if _part in ("raw", "typed"):
        _text = _text.replace("AS Channel\n", f"AS Channel, {', '.join(_MORE)}\n")
    _PARTS[f"{_part}_full"] = re.sub(rf"FROM {_source}\b", f"FROM {_source}_full", _text) if _source else _text
_FULL_COLUMNS = (
    "Order_ID", "Order_Date", "Ship_Date", "Customer_ID", "Region", "Category", "Sub_Category", "Product_ID", "Sales",
    "Quantity", "Discount", "Profit", "Channel", *_MORE,
)
_PARTS["stress_bands"] = _PARTS["bands"].replace("FROM f", "FROM stress")


def _band_result(source: str, keys: str = "") -> str:
    return f"""
SELECT {keys}Discount_Bin, avg(Profit_Margin) AS Avg_Profit_Margin,
       CAST(sum(Profit) AS DOUBLE) / count(*) AS Avg_Profit, CAST(sum(Sales) AS DOUBLE) / count(*) AS Avg_Sales,
       count(*) AS "Count"
FROM {source} WHERE Discount_Bin IS NOT NULL GROUP BY {keys}Discount_Bin"""


_PARTS["lacking"] = """
SELECT * REPLACE (CASE WHEN Order_ID % 11 <> 0 THEN Sales END AS Sales, CASE WHEN Order_ID % 7 <> 0 THEN Profit END AS Profit,
                  CASE WHEN Order_ID % 11 <> 0 AND Order_ID % 7 <> 0 THEN Profit_Margin END AS Profit_Margin)
FROM f"""
_PARTS["lacking_bands"] = _PARTS["bands"].replace("FROM f", "FROM lacking")
_PARTS["disc"] = _band_result("bands")
_PARTS["stress_disc"] = _band_result("stress_bands")
_PARTS["disc_state"] = _band_result("bands", "State, ")
_PARTS["disc_region"] = _band_result("bands", "Region, ")
_PARTS["disc_segment"] = _band_result("bands", "Segment, ")


def _series(keys: str = "") -> dict[str, str]:
    """Monthly series, split, closed-form predictions and metrics; ``keys`` ends with a comma or is empty."""
    name = "_" + keys.rstrip(", ").lower() if keys else ""
    partition = f"PARTITION BY {keys.rstrip(', ')} " if keys else ""
    group = f"GROUP BY {keys}model"
    return {
        f"monthly{name}": f"""
SELECT {keys}Year_Month, CAST(sum(Sales) AS DOUBLE) AS Sales,
       CAST(row_number() OVER ({partition}ORDER BY Year_Month) - 1 AS INTEGER) AS time_idx
FROM f GROUP BY {keys}Year_Month""",
        f"flagged{name}": f"""
SELECT *, time_idx >= count(*) OVER ({partition}) - 12 AS is_test FROM monthly{name}""",
        f"predicted{name}": f"""
SELECT *,
       CASE WHEN is_test THEN max(CASE WHEN NOT is_test AND time_idx = last_train THEN Sales END)
            OVER ({partition}) END AS Pred_Naive,
       CASE WHEN is_test THEN
            regr_intercept(CASE WHEN NOT is_test THEN Sales END, CASE WHEN NOT is_test THEN time_idx END)
                OVER ({partition})
            + regr_slope(CASE WHEN NOT is_test THEN Sales END, CASE WHEN NOT is_test THEN time_idx END)
                OVER ({partition}) * time_idx END AS Pred_LR
FROM (SELECT *, max(CASE WHEN NOT is_test THEN time_idx END) OVER ({partition}) AS last_train
      FROM flagged{name})""",
        f"guesses{name}": f"""
SELECT {keys}Sales, 'Naive Baseline' AS model, 1 AS preference, Pred_Naive AS guess FROM predicted{name} WHERE is_test
UNION ALL
SELECT {keys}Sales, 'Linear Regression', 2, Pred_LR FROM predicted{name} WHERE is_test""",
        f"metrics{name}": f"""
SELECT {keys}model, min(preference) AS preference, round(avg(abs(Sales - guess)), 2) AS MAE,
       round(sqrt(avg((Sales - guess) ** 2)), 2) AS RMSE,
       round(1 - sum((Sales - guess) ** 2) / NULLIF(var_pop(Sales) * count(*), 0), 4) AS R2
FROM guesses{name} {group}""",
    }


for _keys in ("", "Region, ", "State, ", "Segment, "):
    _PARTS.update(_series(_keys))

def _used(sql: str) -> set[str]:
    flat = sql.replace("\n", " ").replace(",", " ").replace(")", " ").replace("(", " ").replace(".", " ")
    return {name for name in _PARTS if f" {name} " in f" {flat} "}


def _with(sql: str) -> str:
    """Put the parts a statement uses, and the parts these use, in front of it."""
    needed, open_names = set(), _used(sql)
    while open_names:
        name = open_names.pop()
        if name not in needed:
            needed.add(name)
            open_names |= _used(_PARTS[name]) - {name}
    depth = {}

    def level(name: str) -> int:
        if name not in depth:
            depth[name] = 1 + max((level(other) for other in _used(_PARTS[name]) - {name}), default=0)
        return depth[name]

    ctes = [f"{name} AS ({_PARTS[name]}\n)" for name in sorted(needed, key=lambda n: (level(n), n))]
    text = "WITH " + ",\n".join(ctes) + "\n" + sql.strip() if ctes else sql.strip()
    return _expand_trim(text)


def _expand_trim(text: str) -> str:
    """``trim_all(x)`` stands for a regular expression (a plain trim drops spaces only), ``read_date(x)`` for the layouts."""
    text = re.sub(
        r"read_date\((\w+)\)",
        r"coalesce(TRY_CAST(trim_all(\1) AS TIMESTAMP), try_strptime(trim_all(\1), ['%m/%d/%Y', '%b %d, %Y']))",
        text,
    )
    return re.sub(r"trim_all\((\w+)\)", r"regexp_replace(\1, '^\\s+|\\s+$', '', 'g')", text)


_STAMP = "'%Y-%m-%d %H:%M:%S'"


def _money(column: str) -> str:
    return f"CAST(round(sum({column}), 2) AS DOUBLE)"


_S, _P = _money("Sales"), _money("Profit")
_O, _C = "count(DISTINCT Order_ID)", "count(DISTINCT Customer_ID)"
# Adding zero turns a negative zero into zero.
_M = "round(CAST(sum(Profit) AS DOUBLE) / NULLIF(CAST(sum(Sales) AS DOUBLE), 0) * 100, 2) + 0"
_KPIS = f"""{_S} AS total_sales, {_P} AS total_profit, {_O} AS total_orders, {_C} AS unique_customers,
       round(CAST(sum(Sales) AS DOUBLE) / {_O}, 2) AS avg_order_value,
       coalesce({_M}, 0) AS overall_profit_margin_pct"""
_TYPED_OUT = f"""Order_ID, strftime(Order_Date, {_STAMP}) AS Order_Date, strftime(Ship_Date, {_STAMP}) AS Ship_Date,
       Customer_ID, Region, Category, Sub_Category, Product_ID, CAST(Sales AS DOUBLE) AS Sales,
       CAST(Quantity AS DOUBLE) AS Quantity, CAST(Discount AS DOUBLE) AS Discount, CAST(Profit AS DOUBLE) AS Profit,
       Channel"""


def _describe(columns: tuple[str, ...], source: str, places: int) -> str:
    def one(c: str) -> str:
        v = f"CAST({c} AS DOUBLE)"
        return f"""SELECT '{c}' AS metric, count({c}) AS n, round(avg({v}), {places}) AS mean,
       round(stddev_samp({v}), {places}) AS std, min({v}) AS min, round(quantile_cont({v}, 0.25), {places}) AS p25,
       round(quantile_cont({v}, 0.5), {places}) AS p50, round(quantile_cont({v}, 0.75), {places}) AS p75,
       max({v}) AS max FROM {source}"""

    return " UNION ALL ".join(one(c) for c in columns)


def _histogram(column: str, source: str, bins: int) -> str:
    return f"""
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * step, 6) AS lower, round(lo + (b.bin + 1) * step, 6) AS upper,
       count(x) AS count
FROM (SELECT unnest(range({bins})) AS bin) AS b
CROSS JOIN (SELECT min(CAST({column} AS DOUBLE)) AS lo, max(CAST({column} AS DOUBLE)) AS hi,
                   (max(CAST({column} AS DOUBLE)) - min(CAST({column} AS DOUBLE))) / {bins}.0 AS step FROM {source}) AS e
LEFT JOIN (SELECT CAST({column} AS DOUBLE) AS x FROM {source}) AS v
       ON x >= lo + b.bin * step AND (x < lo + (b.bin + 1) * step OR b.bin = {bins} - 1)
GROUP BY b.bin, lo, step"""


def _short(column: str) -> str:
    v = f"CAST({column} AS DECIMAL(24,4))"
    return f"""'$' || CASE WHEN abs({v}) >= 1000000
            THEN CAST(round(CAST({v} * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(38,10)), 2) AS VARCHAR) || 'M'
            WHEN abs({v}) >= 1000
            THEN CAST(round(CAST({v} * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(38,10)), 1) AS VARCHAR) || 'K'
            ELSE format('{{:,}}', CAST(round({v}, 0) AS BIGINT)) END"""


def _percent(value: str, places: int) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(28,10)), {places}) AS VARCHAR) || '%'"


def _digest(name: str, parts: dict[str, tuple[str, str | None]], more: str = "") -> str:
    """Rows of each statement, and the sum of one of its columns."""

    def one(key: str, sql: str, measure: str | None) -> str:
        total = f"CAST(round(sum(CAST({measure} AS DECIMAL(38,10))), 2) AS DOUBLE)" if measure else "CAST(NULL AS DOUBLE)"
        return f"SELECT '{key}' AS {name}, count(*) AS n_rows, {total} AS total{more} FROM ({sql})"

    return " UNION ALL ".join(one(key, *part) for key, part in parts.items())


def _context(kpis: str, cat: str, reg: str, metrics: str, disc: str, key: str = "", rfm: bool = True) -> str:
    """All context columns; with ``key`` one row per key value."""
    group = f"GROUP BY {key}" if key else ""
    lead = f"{key}, " if key else ""

    def join(alias: str) -> str:
        return f"LEFT JOIN {alias} USING ({key})" if key else f"CROSS JOIN {alias}"

    def extremes(alias: str, name: str, source: str, labels: tuple[str, str, str, str]) -> str:
        return f"""{alias} AS (SELECT {lead}arg_min({name}, (-Sales, {name})) AS {labels[0]},
       round(arg_min(Sales, (-Sales, {name})), 2) AS {labels[1]},
       arg_min({name}, (Profit_Margin, {name})) AS {labels[2]},
       round(arg_min(Profit_Margin, (Profit_Margin, {name})) * 100, 2) + 0 AS {labels[3]} FROM ({source}) {group})"""

    ctes = [
        f"x_kpi AS ({kpis})",
        extremes("x_cat", "Category", cat, ("top_category_by_sales", "top_category_sales", "worst_margin_category",
                                            "worst_margin_pct")),
        extremes("x_reg", "Region", reg, ("top_region", "top_region_sales", "worst_margin_region",
                                          "worst_margin_region_pct")),
        f"""x_fc AS (SELECT {lead}arg_min(model, (RMSE, preference)) AS best_forecast_model,
       min(RMSE) AS best_forecast_rmse, arg_min(R2, (RMSE, preference)) AS best_forecast_r2
       FROM {metrics} {group})""",
        f"""x_disc AS (SELECT {lead}arg_min(Discount_Bin, (Avg_Profit_Margin, Discount_Bin)) AS worst_discount_bin,
       round(min(Avg_Profit_Margin) * 100, 2) AS worst_discount_margin
       FROM {disc} WHERE Avg_Profit_Margin < 0 {group})""",
    ]
    segments = ""
    if rfm:
        ctes.append(
            f"""x_rfm AS (SELECT {lead}string_agg(RFM_Segment || '=' || n, '; ' ORDER BY RFM_Segment) AS rfm_segments,
       CAST(coalesce(sum(n) FILTER (RFM_Segment = 'Champions'), 0) AS BIGINT) AS champions_count,
       CAST(coalesce(sum(n) FILTER (RFM_Segment = 'At Risk'), 0) AS BIGINT) AS at_risk_count
       FROM (SELECT {lead}RFM_Segment, count(*) AS n FROM rfm GROUP BY {lead}RFM_Segment) {group})"""
        )
        segments = "rfm_segments, champions_count, at_risk_count,"
    else:
        segments = "CAST(NULL AS BIGINT) AS champions_count, CAST(NULL AS BIGINT) AS at_risk_count,"
    body = f"""SELECT {lead}total_sales, total_profit, total_orders, unique_customers, avg_order_value,
       overall_profit_margin_pct AS overall_margin_pct, top_category_by_sales, top_category_sales,
       worst_margin_category, worst_margin_pct, top_region, top_region_sales, worst_margin_region,
       worst_margin_region_pct, {segments} best_forecast_model, best_forecast_rmse, best_forecast_r2,
       worst_discount_bin, worst_discount_margin
FROM x_kpi {join('x_cat')} {join('x_reg')} {join('x_rfm') if rfm else ''} {join('x_fc')} {join('x_disc')}"""
    whole = _with(", ".join(ctes) + " " + body)
    if not whole.startswith("WITH"):
        return "WITH " + whole
    # The local parts continue the list of shared ones.
    head, tail = whole.rsplit("\n)\n", 1)
    return head + "\n),\n" + tail


def _grouped(name: str, key: str) -> str:
    return f"""SELECT {key}, {name}, CAST(sum(Sales) AS DOUBLE) AS Sales,
       CAST(sum(Profit) AS DOUBLE) / NULLIF(CAST(sum(Sales) AS DOUBLE), 0) AS Profit_Margin
FROM f GROUP BY {key}, {name}"""


_CATALOGUE = {
    "q1_sales_profit_by_category": f"""
SELECT Category, {_S} AS Total_Sales, {_P} AS Total_Profit, {_O} AS Order_Count, {_M} AS Profit_Margin_Pct
FROM f GROUP BY Category""",
    "q2_monthly_sales": f"""
SELECT Year_Month, {_S} AS Monthly_Sales, {_P} AS Monthly_Profit FROM f GROUP BY Year_Month""",
    "q3_regional_performance": f"""
SELECT Region, {_S} AS Total_Sales, {_P} AS Total_Profit, {_O} AS Orders, {_C} AS Customers, {_M} AS Profit_Margin_Pct
FROM f GROUP BY Region""",
    "q4_top_customers": f"""
SELECT Customer_ID, Customer_Name, Segment, {_S} AS Total_Sales, {_P} AS Total_Profit, {_O} AS Orders
FROM f GROUP BY Customer_ID, Customer_Name, Segment
ORDER BY Total_Sales DESC, Customer_ID, Customer_Name, Segment LIMIT 10""",
    "q5_top_products": f"""
SELECT Product_ID, Product_Name, Category, Sub_Category, {_S} AS Total_Sales, {_P} AS Total_Profit,
       {_M} AS Profit_Margin_Pct
FROM f GROUP BY Product_ID, Product_Name, Category, Sub_Category
ORDER BY Total_Profit DESC, Product_ID, Product_Name, Category, Sub_Category LIMIT 10""",
    "q6_loss_making_subcategories": f"""
SELECT Category, Sub_Category, {_S} AS Total_Sales, {_P} AS Total_Profit, {_M} AS Profit_Margin_Pct
FROM f GROUP BY Category, Sub_Category HAVING {_P} < 0""",
    "q7_avg_discount": f"""
SELECT Category, round(CAST(sum(Discount) AS DOUBLE) / count(Discount) * 100, 2) AS Avg_Discount_Pct,
       {_S} AS Total_Sales, {_P} AS Total_Profit
FROM f GROUP BY Category""",
    "q8_segments": f"""
SELECT Segment, {_S} AS Total_Sales, {_P} AS Total_Profit, {_C} AS Customers, {_O} AS Orders, {_M} AS Profit_Margin_Pct
FROM f GROUP BY Segment""",
    "q9_high_sales_low_profit": f"""
SELECT * FROM (
  SELECT Product_Name, Category, Sub_Category, {_S} AS Total_Sales, {_P} AS Total_Profit, {_M} AS Profit_Margin_Pct
  FROM f GROUP BY Product_Name, Category, Sub_Category)
WHERE Total_Sales > 1000 AND Profit_Margin_Pct < 5
ORDER BY Total_Sales DESC, Product_Name, Category, Sub_Category LIMIT 20""",
    "q10_yearly": f"""
SELECT CAST(Year AS VARCHAR) AS Year, {_S} AS Total_Sales, {_P} AS Total_Profit, {_O} AS Orders, {_C} AS Customers
FROM f GROUP BY ALL""",
    "q11_ship_modes": f"""
SELECT Ship_Mode, {_O} AS Orders, {_S} AS Total_Sales, round(avg(Days_to_Ship), 1) AS Avg_Days_to_Ship
FROM f GROUP BY Ship_Mode""",
    "q12_states": f"""
SELECT State, Region, {_S} AS Total_Sales, {_P} AS Total_Profit, {_M} AS Profit_Margin_Pct
FROM f GROUP BY State, Region ORDER BY Total_Sales DESC, State, Region LIMIT 15""",
}
_CATALOGUE["q4b_top_customers_without_id"] = (
    f"SELECT Customer_Name, Segment, Total_Sales, Total_Profit, Orders FROM ({_CATALOGUE['q4_top_customers']})"
)

_RESULT_NAMES = {
    "q1_sales_profit_by_category": "total_sales_profit_by_category",
    "q2_monthly_sales": "monthly_sales",
    "q3_regional_performance": "regional_performance",
    "q4_top_customers": "top_10_customers_by_revenue",
    "q5_top_products": "top_10_products_by_profit",
    "q6_loss_making_subcategories": "loss_making_subcategories",
    "q7_avg_discount": "avg_discount_by_category",
    "q8_segments": "sales_profit_by_segment",
    "q9_high_sales_low_profit": "high_sales_low_profit_products",
    "q10_yearly": "yearly_performance",
    "q11_ship_modes": "ship_mode_analysis",
    "q12_states": "state_profitability",
    "q4b_top_customers_without_id": "top_10_customers_without_id",
}

_MEASURES = {
    "q1": "Total_Sales", "q2": "Monthly_Profit", "q3": "Customers", "q4": "Total_Sales", "q4b": "Total_Profit",
    "q5": "Total_Profit", "q6": "Total_Profit", "q7": "Avg_Discount_Pct", "q8": "Orders", "q9": "Total_Sales",
    "q10": "Total_Profit", "q11": "Avg_Days_to_Ship", "q12": "Profit_Margin_Pct",
}

_RFM_OUT = """Customer_ID, Customer_Name, Segment, Recency, Frequency, Monetary, R_Score, F_Score, M_Score, RFM_Score,
       RFM_Segment"""
_SCORED = "SELECT *, R_Score + F_Score + M_Score AS RFM_Score FROM tied_scores"
_BANDED = "round(Avg_Profit_Margin, 6) + 0 AS Avg_Profit_Margin"
_FILTER = "Year IN (1996, 1998) AND Region IN ('ASIA', 'EUROPE') AND Segment = 'FURNITURE'"
_SELECTIONS = {
    "all": "true",
    "years": "Year IN (1996, 1998)",
    "place_and_segment": _FILTER,
    "categories": "Category IN ('PROMO', 'ECONOMY') AND Region IN ('ASIA', 'AFRICA', 'AMERICA')",
    "nothing": "Region IN ('NOWHERE')",
}
_NO_ORDERS = "CAST(NULL AS BIGINT)"
_CUBE_GROUPS = {"Year": _O, "Category": _O, "Region": _O}
_CUBE_GROUPS |= {key: _NO_ORDERS for key in ("Year_Month", "Year_Quarter", "Sub_Category", "State")}
_FACET = """SELECT 'Year' AS facet, CAST(Year AS VARCHAR) AS value FROM f UNION SELECT 'Region', Region FROM f
UNION SELECT 'Category', Category FROM f UNION SELECT 'Segment', Segment FROM f"""
_SUB_TABLE = """SELECT Category, Sub_Category, Sales, Profit, round(Profit_Margin * 100, 1) + 0 AS "Margin_%", Quantity FROM sub"""

_STATEMENTS = {
    # sources and sinks
    "j1_order_lines": f"""
SELECT * REPLACE (strftime(Order_Date, {_STAMP}) AS Order_Date, strftime(Ship_Date, {_STAMP}) AS Ship_Date,
                  CAST(Sales AS DOUBLE) AS Sales, CAST(Discount AS DOUBLE) AS Discount, CAST(Profit AS DOUBLE) AS Profit)
FROM order_lines""",
    "s1_load_raw_orders": f"SELECT * REPLACE (strftime(l_shipdate, {_STAMP}) AS l_shipdate) FROM lineitem",
    "s2_load_returns": """
SELECT DISTINCT 'Yes' AS Returned, CAST(l_orderkey AS VARCHAR) AS "Order ID" FROM lineitem WHERE l_returnflag = 'R'""",
    "s3_save_processed": f"""
SELECT Order_ID, strftime(Order_Date, {_STAMP}) AS Order_Date, CAST(Sales AS DOUBLE) AS Sales,
       CAST(Profit AS DOUBLE) AS Profit, Quantity, Year, Month, Quarter, Month_Name, Year_Month, Year_Quarter,
       Profit_Margin, Sales_per_Unit, Profit_per_Unit, Is_Profitable FROM f""",
    "s4_load_processed": f"SELECT Year, {_KPIS} FROM f GROUP BY Year",
    "s5_published_rows": "SELECT count(*) AS n FROM f",
    "s5_lookups": " UNION ALL ".join(
        f"""
SELECT '{name}' AS lookup, Order_ID, Customer_ID, CAST(Sales AS DOUBLE) AS Sales, CAST(Profit AS DOUBLE) AS Profit,
       strftime(Order_Date, {_STAMP}) AS Order_Date
FROM f WHERE {wanted}"""
        for name, wanted in {
            "order": "Order_ID = 7",
            "customers": "Customer_ID IN (7, 40, 100)",
            "day": "Order_Date = (SELECT min(Order_Date) FROM f)",
        }.items()
    ),
    "s6_run_query": f"SELECT Segment, Year_Month AS Period, count(*) AS n, {_S} AS Sales FROM f GROUP BY Segment, Year_Month",
    "s7_catalogue_results": _digest(
        "query", {_RESULT_NAMES[k]: (v, _MEASURES[k.split("_")[0]]) for k, v in _CATALOGUE.items()}, ", false AS failed"
    )
    + " UNION ALL SELECT 'broken', NULL, NULL, true UNION ALL SELECT 'broken_while_running', NULL, NULL, true",
    # cleaning
    "c1_canonical_names": "SELECT * FROM raw",
    "c2_parse_dates": f"""
SELECT raw.Order_ID, strftime(read_date(Order_Date), {_STAMP}) AS Order_Date,
       strftime(TRY_CAST(trim_all(Ship_Date) AS TIMESTAMP), {_STAMP}) AS Ship_Date FROM raw""",
    "c2_date_layouts": f"""
SELECT Order_ID, strftime(CASE
    WHEN Order_ID % 13 IN (0, 5, 8, 9, 11) THEN CAST(Order_Date AS TIMESTAMP)
    WHEN Order_ID % 13 IN (4, 6, 10) THEN date_trunc('minute', moment)
    WHEN Order_ID % 13 = 2 THEN moment - INTERVAL 2 HOUR
    ELSE moment END, {_STAMP}) AS Order_Date
FROM (SELECT Order_ID, Order_Date, Order_Date + to_hours(Order_ID % 24) + to_minutes(Order_ID % 60) + to_seconds(Order_ID % 59) AS moment
      FROM order_lines)""",
    "c3_strip_text": """
SELECT trim_all(Order_ID) AS Order_ID, trim_all(Category) AS Category, trim_all(Sales) AS Sales, Channel FROM raw""",
    "c4_coerce_measures": """
SELECT Order_ID, CAST(Sales AS DOUBLE) AS Sales, CAST(Quantity AS DOUBLE) AS Quantity,
       CAST(Discount AS DOUBLE) AS Discount, CAST(Profit AS DOUBLE) AS Profit FROM typed""",
    "c5_drop_missing": f"SELECT {_TYPED_OUT} FROM core",
    "c6_drop_duplicates": f"SELECT {_TYPED_OUT} FROM dedup",
    "c7_clean_orders": f"SELECT {_TYPED_OUT} FROM clean",
    "c8_range_flags": """
SELECT count(*) FILTER (Discount < 0 OR Discount > 1) AS discounts_out_of_range,
       count(*) FILTER (Quantity < 1) AS quantity_below_one, count(*) FILTER (Sales < 0) AS negative_sales
FROM dedup""",
    "c9_cleaning_audit": """
SELECT (SELECT count(*) FROM typed) AS rows_in,
       (SELECT count(*) FROM typed) - (SELECT count(*) FROM core) AS dropped_missing,
       (SELECT count(*) FROM core) - (SELECT count(*) FROM dedup) AS dropped_duplicates,
       count(*) FILTER (Discount < 0 OR Discount > 1) AS clipped_discounts,
       count(*) FILTER (Quantity < 1) AS quantity_below_one, count(*) FILTER (Sales < 0) AS negative_sales,
       count(*) AS rows_out
FROM dedup""",
    # features and formats
    "f1_f7_calendar": f"""
SELECT Order_ID, strftime(Order_Date, {_STAMP}) AS Order_Date, strftime(Ship_Date, {_STAMP}) AS Ship_Date, Year, Month,
       Quarter, Month_Name, Year_Month, Year_Quarter, Days_to_Ship FROM f""",
    "f8_f11_margins": """
SELECT Order_ID, CAST(Sales AS DOUBLE) AS Sales, CAST(Profit AS DOUBLE) AS Profit, Quantity, Profit_Margin,
       Sales_per_Unit, Profit_per_Unit, Is_Profitable FROM f""",
    "f8_f11_margins_dirty": """
SELECT Order_ID, Product_ID, CAST(Sales AS DOUBLE) AS Sales, CAST(Profit AS DOUBLE) AS Profit,
       CAST(Quantity AS DOUBLE) AS Quantity, CAST(Profit AS DOUBLE) / NULLIF(CAST(Sales AS DOUBLE), 0) AS Profit_Margin,
       CAST(Sales AS DOUBLE) / NULLIF(CAST(Quantity AS DOUBLE), 0) AS Sales_per_Unit,
       CAST(Profit AS DOUBLE) / NULLIF(CAST(Quantity AS DOUBLE), 0) AS Profit_per_Unit, Profit > 0 AS Is_Profitable
FROM clean""",
    "f12_discount_bin": "SELECT Order_ID, CAST(Discount AS DOUBLE) AS Discount, Discount_Bin FROM stress_bands",
    "f13_rfm_segment": "SELECT Customer_ID, RFM_Score, RFM_Segment FROM rfm",
    "f14_is_loss": "SELECT Category, Profit < 0 AS Is_Loss, count(*) AS n FROM sub GROUP BY ALL",
    "f17_short_currency": f"""
SELECT Customer_ID, {_short('Total_Sales')} AS Total_Sales, {_short('Total_Profit')} AS Total_Profit FROM cust""",
    "f18_percent": f"""
SELECT State, {_percent('m * 100', 1)} AS one, {_percent('m * 100', 2)} AS two
FROM (SELECT State, CAST(sum(Profit) AS DOUBLE) / NULLIF(CAST(sum(Sales) AS DOUBLE), 0) AS m FROM f GROUP BY State)""",
    "f20_formatted_report": f"""
SELECT Category, '$' || format('{{:,.2f}}', Total_Sales) AS Total_Sales,
       '$' || format('{{:,.2f}}', Total_Profit) AS Total_Profit, Order_Count,
       {_percent('Profit_Margin_Pct', 2)} AS Profit_Margin_Pct
FROM ({_CATALOGUE['q1_sales_profit_by_category']})""",
    "f21_thousands": """
SELECT Year_Month, CAST(sum(Sales) AS DOUBLE) / 1000 AS Sales, CAST(sum(Profit) AS DOUBLE) / 1000 AS Profit
FROM f GROUP BY Year_Month""",
    "f22_strftime": """
SELECT strftime(Order_Date, '%Y') AS y, strftime(Order_Date, '%Y-%m') AS ym, strftime(Order_Date, '%Y-%m-%d') AS ymd,
       count(*) AS n FROM f GROUP BY ALL""",
    "f22_strftime_codes": """
SELECT Order_ID, strftime(t, 'Q%m') AS quarterly, strftime(t, '%y') AS short_year, strftime(t, '%j') AS day_of_year,
       strftime(t, '%U/%W/%V') AS weeks, strftime(t, '%w %u %a %A') AS weekdays, strftime(t, '%G-W%V') AS iso_year,
       strftime(t, '%H:%M:%S') AS clock, strftime(t, '%I o''clock %p') AS halves, strftime(t, '%d %b (%B)') AS names,
       strftime(t, '100%% of %Y') AS percent, CAST(CAST(epoch(t) AS BIGINT) AS VARCHAR) AS seconds,
       strftime(t, '%Y-%m-%d %H:%M:%S %H:%M %m/%d/%y') AS long
FROM (SELECT Order_ID, Order_Date + to_hours(Order_ID % 24) + to_minutes(Order_ID % 60) + to_seconds(Order_ID % 59) AS t FROM order_lines)""",
    "f23_round": """
SELECT Order_ID, CAST(round(sum(Sales), 2) AS DOUBLE) AS r2, CAST(round(sum(Sales), 1) AS DOUBLE) AS r1
FROM f GROUP BY Order_ID""",
    # profiling
    "p1_shape": "SELECT count(*) AS n_rows, 17 AS n_columns FROM order_lines",
    "p2_column_types": "SELECT column_name, dtype, n - missing_count AS present FROM doc_missing",
    "p3_p4_missing_values": """
SELECT column_name, missing_count, round(missing_count * 100.0 / n, 2) AS missing_pct FROM doc_missing""",
    "p3_p4_missing_values_typed_orders": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
        f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct FROM typed"
        for c in ("Order_ID", "Order_Date", "Ship_Date", "Customer_ID", "Region", "Category", "Sub_Category",
                  "Product_ID", "Sales", "Quantity", "Discount", "Profit", "Channel")
    ),
    "p5_duplicate_rows": """
SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS duplicate_rows""",
    "p6_describe_numeric": _describe(("Sales", "Quantity", "Discount", "Profit"), "f", 4),
    "p7_columns_with_missing": """
SELECT column_name, dtype, missing_count, round(missing_count * 100.0 / n, 2) AS missing_pct
FROM doc_missing WHERE missing_count > 0""",
    "p8_date_ranges": f"""
SELECT 'Order_Date' AS column_name, strftime(min(Order_Date), {_STAMP}) AS first,
       strftime(max(Order_Date), {_STAMP}) AS last FROM f
UNION ALL
SELECT 'Ship_Date', strftime(min(Ship_Date), {_STAMP}), strftime(max(Ship_Date), {_STAMP}) FROM f""",
    "p9_distinct_values": """
SELECT 'Category' AS column_name, Category AS value FROM f UNION SELECT 'Sub_Category', Sub_Category FROM f
UNION SELECT 'Segment', Segment FROM f UNION SELECT 'Region', Region FROM f UNION SELECT 'Ship_Mode', Ship_Mode FROM f""",
    "p6_describe_sketched": """
SELECT metric, count(*) AS n, round(avg(x), 4) AS mean, min(x) AS min, max(x) AS max, true AS within_bound
FROM (UNPIVOT (SELECT CAST(Sales AS DOUBLE) AS Sales, CAST(Quantity AS DOUBLE) AS Quantity, CAST(Profit AS DOUBLE) AS Profit FROM f)
      ON Sales, Quantity, Profit INTO NAME metric VALUE x)
GROUP BY metric""",
    "p10_describe_rounded": f"""
SELECT metric, n, mean, std, round(min, 2) AS min, p25, p50, p75, round(max, 2) AS max
FROM ({_describe(("Sales", "Quantity", "Discount", "Profit"), "f", 2)})""",
    "p11_histogram_sales": _histogram("Sales", "f", 60),
    "p11_histogram_profit": _histogram("Profit", "f", 60),
    "p11_histogram_discount": _histogram("Discount", "f", 20),
    # filters
    "w1_filtered_kpis": f"SELECT {_KPIS} FROM f WHERE {_FILTER}",
    "w1_empty_selection": f"SELECT {_KPIS} FROM f",
    "w2_facets": _FACET,
    "w3_selected_rows": f"SELECT count(*) AS selected FROM f WHERE {_FILTER}",
    "w1_cube_kpis": " UNION ALL ".join(
        # Nothing sums to zero.
        f"""SELECT * REPLACE (coalesce(total_sales, 0) AS total_sales, coalesce(total_profit, 0) AS total_profit)
FROM (SELECT '{name}' AS selection, {_KPIS} FROM f WHERE {chosen})"""
        for name, chosen in _SELECTIONS.items()
    ),
    "w1_cube_groups": " UNION ALL ".join(
        f"""
SELECT '{name}' AS selection, '{key}' AS grouping, CAST({key} AS VARCHAR) AS value, CAST(sum(Sales) AS DOUBLE) AS Sales,
       CAST(sum(Profit) AS DOUBLE) AS Profit, {orders} AS Orders
FROM f WHERE {chosen} GROUP BY {key}"""
        for name, chosen in _SELECTIONS.items()
        for key, orders in _CUBE_GROUPS.items()
    ),
    "w4_empty_guard": """
SELECT 'nowhere' AS selection, count(*) = 0 AS is_empty, count(*) AS selected FROM f WHERE Region = 'NOWHERE'
UNION ALL SELECT 'asia', count(*) = 0, count(*) FROM f WHERE Region = 'ASIA'""",
    "w5_negative_margins": f"""
SELECT * REPLACE ({_BANDED}) FROM stress_disc WHERE Avg_Profit_Margin < 0""",
    # sales
    "a1_kpis": f"SELECT {_KPIS} FROM f",
    "a1_kpis_by_state": f"SELECT State, {_KPIS} FROM f GROUP BY State",
    "a2_sales_by_year": f"""
SELECT Year, CAST(sum(Sales) AS DOUBLE) AS Sales, CAST(sum(Profit) AS DOUBLE) AS Profit, {_O} AS Orders
FROM f GROUP BY Year""",
    "a3_monthly_trend": """
SELECT Year_Month, CAST(sum(Sales) AS DOUBLE) AS Sales, CAST(sum(Profit) AS DOUBLE) AS Profit
FROM f GROUP BY Year_Month""",
    "a4_quarterly_sales": """
SELECT Year, Quarter, Year_Quarter, CAST(sum(Sales) AS DOUBLE) AS Sales, CAST(sum(Profit) AS DOUBLE) AS Profit
FROM f GROUP BY Year, Quarter, Year_Quarter""",
    "a5_sales_by_category": "SELECT * FROM cat",
    "a5_sales_by_category_null_keys": f"""
SELECT Category, CAST(sum(Sales) AS DOUBLE) AS Sales, CAST(sum(Profit) AS DOUBLE) AS Profit, {_O} AS Orders,
       CAST(sum(Profit) AS DOUBLE) / CAST(sum(Sales) AS DOUBLE) AS Profit_Margin
FROM null_keys WHERE Category IS NOT NULL GROUP BY Category""",
    "a6_sales_by_subcategory": "SELECT * FROM sub",
    "a7_sales_by_region": "SELECT * FROM reg",
    "a8_sales_by_state": """
SELECT State, CAST(sum(Sales) AS DOUBLE) AS Sales, CAST(sum(Profit) AS DOUBLE) AS Profit,
       CAST(sum(Profit) AS DOUBLE) / CAST(sum(Sales) AS DOUBLE) AS Profit_Margin
FROM f GROUP BY State""",
    "a9_profitability_by_subcategory": "SELECT *, Profit < 0 AS Is_Loss FROM sub",
    "a10_discount_bins": f"SELECT * REPLACE ({_BANDED}) FROM disc",
    "a10_discount_bins_stress": f"SELECT * REPLACE ({_BANDED}) FROM stress_disc",
    "a11_run_all_eda": _digest(
        "result",
        {
            "kpis": (f"SELECT {_KPIS} FROM f", "avg_order_value"),
            "sales_by_year": (f"SELECT Year, {_O} AS Orders FROM f GROUP BY Year", "Orders"),
            "monthly_trend": ("SELECT sum(Sales) AS Sales FROM f GROUP BY Year_Month", "Sales"),
            "quarterly_sales": ("SELECT sum(Profit) AS Profit FROM f GROUP BY Year_Quarter", "Profit"),
            "sales_by_category": ("SELECT * FROM cat", "Orders"),
            "sales_by_subcategory": ("SELECT * FROM sub", "Quantity"),
            "sales_by_region": ("SELECT * FROM reg", "Orders"),
            "sales_by_state": ("SELECT sum(Profit) AS Profit FROM f GROUP BY State", "Profit"),
            "profitability_by_subcategory": ("SELECT * FROM sub", "Profit"),
            "discount_profit": ("SELECT * FROM disc", "Avg_Sales"),
        },
    ),
    "a11_discounts_from_sets": f"SELECT * REPLACE ({_BANDED}) FROM disc",
    "a11_subcategories_from_sets": "SELECT *, Profit < 0 AS Is_Loss FROM sub",
    "a11_discounts_missing_measures": f"""
SELECT * REPLACE ({_BANDED})
FROM (SELECT Discount_Bin, avg(Profit_Margin) AS Avg_Profit_Margin, CAST(sum(Profit) AS DOUBLE) / count(Profit) AS Avg_Profit,
             CAST(sum(Sales) AS DOUBLE) / count(Sales) AS Avg_Sales, count(Sales) AS "Count"
      FROM lacking_bands WHERE Discount_Bin IS NOT NULL GROUP BY Discount_Bin)
CROSS JOIN (SELECT unnest(['lines', 'sets']) AS way)""",
    # SQL catalogue
    **_CATALOGUE,
    "q3_regional_performance_null_keys": f"""
SELECT Region, {_S} AS Total_Sales, {_P} AS Total_Profit, {_O} AS Orders, {_C} AS Customers, {_M} AS Profit_Margin_Pct
FROM null_keys GROUP BY Region""",
    # customers
    "k1_customer_table": "SELECT * FROM cust",
    "k2_k3_rfm_base": "SELECT * FROM rfm_base",
    "k4_k6_rfm": f"SELECT {_RFM_OUT} FROM rfm",
    "k5_rfm_tied": f"""
SELECT *, CASE WHEN RFM_Score >= 11 THEN 'Champions' WHEN RFM_Score >= 9 THEN 'Loyal Customers'
               WHEN RFM_Score >= 7 THEN 'Potential Loyalists' WHEN RFM_Score >= 5 THEN 'At Risk'
               ELSE 'Lost / Inactive' END AS RFM_Segment
FROM ({_SCORED})""",
    "k7_segment_counts": 'SELECT RFM_Segment AS Segment, count(*) AS "Count" FROM rfm GROUP BY RFM_Segment',
    "k8_segment_revenue": """
SELECT RFM_Segment, CAST(round(sum(CAST(Monetary AS DECIMAL(18,4))), 2) AS DOUBLE) AS Monetary
FROM rfm GROUP BY RFM_Segment""",
    "k9_top_customers": """
SELECT * FROM cust ORDER BY Total_Sales DESC, Customer_ID, Customer_Name, Segment LIMIT 20""",
    "k9_top_rfm": f"""
SELECT {_RFM_OUT} FROM rfm ORDER BY Monetary DESC, Customer_ID, Customer_Name, Segment LIMIT 25""",
    "k10_customer_kpis": """
SELECT count(*) AS customers,
       round(CAST(sum(CAST(Total_Sales AS DECIMAL(18,4))) AS DOUBLE) / count(*), 2) AS avg_revenue,
       max(Total_Sales) AS top_revenue, (SELECT count(*) FROM rfm WHERE RFM_Segment = 'Champions') AS champions,
       (SELECT count(*) FROM rfm WHERE RFM_Segment = 'At Risk') AS at_risk, round(avg(Total_Orders), 2) AS avg_orders
FROM cust""",
    "k11_revenue_histogram": _histogram("Total_Sales", "cust", 40),
    "k11_score_histogram": 'SELECT RFM_Score, count(*) AS "Count" FROM rfm GROUP BY RFM_Score',
    "k12_scatter_feed": "SELECT Customer_ID, Frequency, Monetary, Recency FROM rfm_base",
    # products
    "d1_product_kpis": f"""
SELECT Category || ' Margin' AS label, {_percent('Profit_Margin * 100', 1)} AS value FROM cat
UNION ALL SELECT 'Loss-Making', CAST(count(*) AS VARCHAR) FROM sub WHERE Profit < 0
UNION ALL SELECT 'Profitable', CAST(count(*) AS VARCHAR) FROM sub WHERE Profit >= 0""",
    "d2_median_subcategory_sales": "SELECT round(median(Sales), 4) AS median_sales FROM sub",
    "d3_subcategory_table": _SUB_TABLE,
    "d3_subcategory_table_text": f"""
SELECT Category, Sub_Category,
       '$' || format('{{:,}}', CAST(round(CAST(Sales AS DECIMAL(28,4)), 0) AS BIGINT)) AS Sales,
       '$' || format('{{:,}}', CAST(round(CAST(Profit AS DECIMAL(28,4)), 0) AS BIGINT)) AS Profit,
       {_percent('"Margin_%"', 1)} AS "Margin_%", format('{{:,}}', CAST(Quantity AS BIGINT)) AS Quantity
FROM ({_SUB_TABLE})""",
    "d4_f16_f19_discount_chart": f"""
SELECT * REPLACE ({_BANDED}), round(Avg_Profit_Margin * 100, 6) AS Avg_Margin_Pct,
       Avg_Profit_Margin * 100 < 0 AS Is_Negative FROM stress_disc""",
    "d5_f15_region_chart": """
SELECT *, Profit_Margin * 100 AS Margin_Pct,
       CASE WHEN Profit_Margin * 100 >= 10 THEN 'good' WHEN Profit_Margin * 100 >= 5 THEN 'watch' ELSE 'poor' END
           AS Margin_Band FROM reg""",
    "f15_margin_band": """
SELECT Customer_ID, CASE WHEN Profit_Margin * 100 >= 10 THEN 'good' WHEN Profit_Margin * 100 >= 5 THEN 'watch'
                         ELSE 'poor' END AS Margin_Band FROM cust""",
    "d6_top_and_worst": """
SELECT 'Category' AS dimension, arg_min(Category, (-Sales, Category)) AS top_name, max(Sales) AS top_sales,
       arg_min(Category, (Profit_Margin, Category)) AS worst_name, min(Profit_Margin) AS worst_margin FROM cat
UNION ALL
SELECT 'Region', arg_min(Region, (-Sales, Region)), max(Sales), arg_min(Region, (Profit_Margin, Region)),
       min(Profit_Margin) FROM reg""",
    "d7_profit_chart": "SELECT Category, Sub_Category, Profit, Profit < 0 AS Is_Negative FROM sub",
    # forecasting
    "t1_monthly_series": "SELECT * FROM monthly",
    "t1_monthly_series_by_state": "SELECT * FROM monthly_state",
    "t2_test_months": "SELECT * FROM flagged",
    "t3_naive_baseline": "SELECT Year_Month, Sales, time_idx, Pred_Naive FROM predicted WHERE is_test",
    "t4_linear_trend": """
SELECT Year_Month, Sales, time_idx, Pred_Naive, round(Pred_LR, 2) AS Pred_LR FROM predicted WHERE is_test""",
    "t4_trend_by_region": """
SELECT Region, Year_Month, Sales, time_idx, Pred_Naive, round(Pred_LR, 2) AS Pred_LR
FROM predicted_region WHERE is_test""",
    "t6_metrics": "SELECT model, MAE, RMSE, R2 FROM metrics",
    "t6_metrics_by_region": "SELECT Region, model, MAE, RMSE, R2 FROM metrics_region",
    "t7_best_model": "SELECT model, MAE, RMSE, R2 FROM metrics ORDER BY RMSE, preference LIMIT 1",
    "t9_plot_feed": """
SELECT Year_Month, Sales, time_idx, Pred_Naive, round(Pred_LR, 2) AS Pred_LR,
       CASE WHEN is_test THEN 'test' ELSE 'train' END AS part, last_train AS split_idx FROM predicted""",
    # bundles
    "o2_customer_analysis": _digest(
        "result", {"customer_table": ("SELECT * FROM cust", "Total_Profit"), "rfm": ("SELECT * FROM rfm", "RFM_Score")}
    ),
    "o1_run_all": _digest(
        "step",
        {
            "quality": (
                " UNION ALL ".join(f"SELECT count(*) - count({c}) AS m FROM raw_full" for c in _FULL_COLUMNS), "m"
            ),
            "audit": (
                "SELECT unnest([(SELECT count(*) FROM typed_full), "
                "(SELECT count(*) FROM typed_full) - (SELECT count(*) FROM core_full), "
                "(SELECT count(*) FROM core_full) - (SELECT count(*) FROM dedup_full), "
                "(SELECT count(*) FROM dedup_full WHERE Discount < 0 OR Discount > 1), "
                "(SELECT count(*) FROM dedup_full WHERE Quantity < 1), "
                "(SELECT count(*) FROM dedup_full WHERE Sales < 0), (SELECT count(*) FROM dedup_full)]) AS v",
                "v",
            ),
            "lines": ("SELECT Profit FROM clean_full", "Profit"),
            "monthly": (
                "SELECT row_number() OVER (ORDER BY m) - 1 AS i "
                "FROM (SELECT DISTINCT strftime(Order_Date, '%Y-%m') AS m FROM clean_full)",
                "i",
            ),
            "metrics": ("SELECT unnest(range(2))", None),
            "report": ("SELECT 1", None),
            "by_category": (
                "SELECT sum(Profit) AS Profit FROM clean_full WHERE Category IS NOT NULL GROUP BY Category", "Profit"
            ),
            "by_region": (f"SELECT {_O} AS Orders FROM clean_full GROUP BY Region", "Orders"),
            "discounts": (
                """SELECT count(*) AS n FROM clean_full WHERE Discount IS NOT NULL
                   GROUP BY CASE WHEN Discount < 0.001 THEN 0 WHEN Discount < 0.1 THEN 1 WHEN Discount < 0.2 THEN 2
                                 WHEN Discount < 0.8 THEN 3 ELSE 4 END""",
                "n",
            ),
            "categories_sql": (
                "SELECT round(sum(CAST(Profit AS DECIMAL(38,10))), 2) AS p FROM clean_full GROUP BY Category", "p"
            ),
        },
    ),
    "t5_random_forest": "SELECT Year_Month, Sales, time_idx, true AS RF_in_range FROM predicted WHERE is_test",
    "t8_all_predictions": """
SELECT Year_Month, Sales, time_idx, Pred_Naive, round(Pred_LR, 2) AS Pred_LR, true AS RF_in_range
FROM predicted WHERE is_test""",
    "t11_run_forecasting": """
SELECT model, MAE, RMSE, R2, true AS consistent, true AS ordered FROM metrics
UNION ALL SELECT 'Random Forest', NULL, NULL, NULL, true, true""",
}

ORACLES = {name: _with(sql) for name, sql in _STATEMENTS.items()}
ORACLES["i1_context"] = _context(
    f"SELECT {_KPIS} FROM f", "SELECT * FROM cat", "SELECT * FROM reg", "metrics", "disc"
)
ORACLES["i1_context_by_state"] = _context(
    f"SELECT State, {_KPIS} FROM f GROUP BY State",
    _grouped("Category", "State"),
    _grouped("Region", "State"),
    "metrics_state",
    "disc_state",
    "State",
    rfm=False,
)
ORACLES["i1_context_by_segment"] = _context(
    f"SELECT Segment, {_KPIS} FROM f GROUP BY Segment",
    _grouped("Category", "Segment"),
    _grouped("Region", "Segment"),
    "metrics_segment",
    "disc_segment",
    "Segment",
)


def _report(context: str, key: str = "") -> str:
    """The report text made from a context statement with the wording of the report."""
    lead = f"{key}, " if key else ""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def whole(column: str) -> str:
        return f"format('{{:,}}', CAST(round(CAST({column} AS DECIMAL(28,10)), 0) AS BIGINT))"

    def places(column: str, n: int) -> str:
        return f"CAST(round(CAST({column} AS DECIMAL(28,10)), {n}) AS VARCHAR)"

    def paragraph(template: str, *values: str) -> str:
        return f"printf({text(template)}, {', '.join(values)}) || chr(10)"

    health = paragraph(
        wording.HEALTH,
        whole("total_sales"), whole("total_orders"), whole("unique_customers"), places("overall_margin_pct", 1),
    )
    category = paragraph(
        wording.CATEGORY,
        "top_category_by_sales", whole("top_category_sales"), "worst_margin_category", places("worst_margin_pct", 1),
    )
    region = paragraph(
        wording.REGION,
        "top_region", whole("top_region_sales"), "worst_margin_region", places("worst_margin_region_pct", 1),
    )
    discount = f"""CASE WHEN worst_discount_bin IS NOT NULL THEN
       {paragraph(wording.DISCOUNT, 'worst_discount_bin', places('worst_discount_margin', 1))} END"""
    customers = f"""CASE WHEN champions_count IS NOT NULL THEN
       {paragraph(wording.CUSTOMERS, 'CAST(champions_count AS VARCHAR)', 'CAST(at_risk_count AS VARCHAR)')} END"""
    fit = f"CASE WHEN best_forecast_r2 > 0.5 THEN {text(wording.GOOD_FIT)} ELSE {text(wording.LIMITED_FIT)} END"
    forecast = paragraph(
        wording.FORECAST, "best_forecast_model", whole("best_forecast_rmse"), places("best_forecast_r2", 3), fit
    )
    return f"""SELECT {lead}concat_ws(chr(10), {text(wording.HEADING)}, {health}, {category}, {region}, {discount},
       {customers}, {forecast}, {text(wording.CLOSING)}) AS report
FROM ({context})"""


ORACLES["i2_report"] = _report(ORACLES["i1_context"])
ORACLES["i2_i3_insights"] = f"SELECT report, 'template' AS mode FROM ({ORACLES['i2_report']})"
ORACLES["i2_report_by_state"] = _report(ORACLES["i1_context_by_state"], "State")
_BY_REGION = _context(
    f"SELECT Region, {_KPIS} FROM f GROUP BY Region",
    _grouped("Category", "Region"),
    "SELECT * FROM reg",
    "metrics_region",
    "disc_region",
    "Region",
    rfm=False,
)
ORACLES["s8_saved_report"] = (
    f"SELECT unnest(string_split(report, chr(10))) AS value FROM ({_report(_BY_REGION, 'Region')})"
)
