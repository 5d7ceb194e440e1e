"""Independent SQL for every query of the catalogue, run by DuckDB over the same tables.

Written from the operator definitions, in the plainest form (full windows, no rewrites). All queries
share one set of common table expressions; unused ones cost nothing.
"""
from __future__ import annotations

from stockhealth.plans.inputs import LEDGER_SQL

_LEDGER = LEDGER_SQL.format(lineitem="lineitem", part="part", supplier="supplier")

_PREFIX = f"""
WITH RECURSIVE stock_daily AS MATERIALIZED ({_LEDGER}),
it AS (SELECT p_type AS item, ROW_NUMBER() OVER (ORDER BY p_type) - 1 AS ix FROM (SELECT DISTINCT p_type FROM part)),
ns AS (SELECT COUNT(*) AS n FROM supplier),
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
action_logs AS MATERIALIZED (
  SELECT e.event_id + 1 AS action_id, CAST(e.ts AS TIMESTAMP) AS action_timestamp,
    concat('user_', CAST(e.user_id AS VARCHAR)) AS user_id,
    CASE e.event_type WHEN 'view' THEN 'VIEW_DETAILS' WHEN 'click' THEN 'ACKNOWLEDGE_ALERT'
      WHEN 'purchase' THEN 'CREATE_PO' WHEN 'signup' THEN 'EXPORT_CSV' ELSE 'DISMISS_ALERT' END AS action_type,
    CASE WHEN k % 20 = 19 THEN NULL ELSE s.s_name END AS location, it.item AS item, e.props AS action_details,
    CASE k % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' ELSE 'Unknown' END AS priority,
    e.value AS days_of_cover, CAST(k AS DOUBLE) AS suggested_reorder,
    CASE k % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'COMPLETED' ELSE 'CANCELLED' END AS status
  FROM ev e CROSS JOIN ns JOIN supplier s ON s.s_suppkey = e.user_id % ns.n JOIN it ON it.ix = k % (SELECT COUNT(*) FROM it)),
clock AS (SELECT MAX(action_timestamp) AS now FROM action_logs),
numbered AS MATERIALIZED (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY location, item ORDER BY date) AS ahead,
    COUNT(*) OVER (PARTITION BY location, item) AS n
  FROM stock_daily),
lent AS (SELECT location, item, ahead + later AS ahead, AVG(issued) AS avg_issue -- every row counts for itself and the six after it
  FROM numbered, unnest(range(7)) AS t(later) GROUP BY ALL),
usage AS MATERIALIZED (
  SELECT d.*, d.n - d.ahead + 1 AS back, l.avg_issue
  FROM numbered d JOIN lent l ON l.location = d.location AND l.item = d.item AND l.ahead = d.ahead),
bounds(rule, rank, days, plus_lead, closed) AS (VALUES
  ('status', 0, 2.0::DOUBLE, 0, FALSE), ('status', 1, 5.0, 0, TRUE), ('status', 2, 'Infinity', 0, TRUE),
  ('priority', 0, 0.0, 0, TRUE), ('priority', 1, 1.0, 1, TRUE), ('priority', 1, 2.0, 0, FALSE), ('priority', 2, 5.0, 0, TRUE),
  ('priority', 3, 'Infinity', 0, TRUE)),
ratio AS (SELECT *, closing_stock / NULLIF(avg_issue, 0) AS days_of_cover FROM usage),
within AS ( -- the first bound that holds the days of cover
  SELECT r.location, r.item, r.ahead, MIN(b.rank) FILTER (b.rule = 'status') AS band,
    MIN(b.rank) FILTER (b.rule = 'priority' AND r.lead_time_days IS NOT NULL) AS urgent
  FROM ratio r JOIN bounds b ON r.days_of_cover < b.days + b.plus_lead * COALESCE(r.lead_time_days, 0)
    OR (b.closed AND r.days_of_cover = b.days + b.plus_lead * COALESCE(r.lead_time_days, 0))
  GROUP BY ALL),
scored AS MATERIALIZED (
  SELECT r.*, COALESCE(avg_issue, 0) AS avg_daily_issue, COALESCE(urgent, 4) AS rank,
    ['red', 'orange', 'green', 'unknown'][COALESCE(band, 3) + 1] AS status,
    ['Critical', 'High', 'Medium', 'Low', 'Unknown'][COALESCE(urgent, 4) + 1] AS priority,
    days_of_cover - lead_time_days AS urgency_score,
    CASE WHEN closing_stock IS NOT NULL THEN GREATEST(0, 5 * COALESCE(avg_issue, 0) - closing_stock) END AS suggested_reorder,
    CASE WHEN closing_stock IS NOT NULL THEN GREATEST(0, closing_stock - 30 * COALESCE(avg_issue, 0)) END AS potential_waste,
    ROUND((5 + lead_time_days) * COALESCE(avg_issue, 0), 0) AS optimal_stock
  FROM ratio r LEFT JOIN within w ON w.location = r.location AND w.item = r.item AND w.ahead = r.ahead),
metrics AS MATERIALIZED (
  SELECT date, location, item, closing_stock, avg_daily_issue, days_of_cover, lead_time_days, status,
    suggested_reorder, urgency_score, priority, potential_waste, optimal_stock, rank
  FROM scored WHERE back = 1),
at_risk AS (SELECT * FROM metrics WHERE days_of_cover IS NULL OR days_of_cover <= 5),
history AS (SELECT *, COUNT(*) OVER (PARTITION BY location, item) AS m FROM usage WHERE back <= 14),
fit AS (
  SELECT location, item, COUNT(*) AS history_rows, AVG(issued) AS avg_issued,
    CAST(COUNT(*) * SUM(ahead * issued) - SUM(ahead) * SUM(issued) AS DOUBLE)
      / NULLIF(CAST(COUNT(*) * SUM(ahead * ahead) - SUM(ahead) * SUM(ahead) AS DOUBLE), 0) AS trend_slope
  FROM history GROUP BY location, item),
raw_forecast AS (SELECT *, avg_issued + COALESCE(7 * trend_slope, 0) AS raw FROM fit),
forecast AS MATERIALIZED (
  SELECT location, item, CASE WHEN raw > 0 THEN round_even(raw, 2) END AS ml_forecasted_demand FROM raw_forecast),
latest AS (
  SELECT u.*, round_even(u.avg_issue, 2) AS avg2, f.ml_forecasted_demand AS ml
  FROM usage u LEFT JOIN forecast f ON f.location = u.location AND f.item = u.item WHERE back = 1),
variants AS (
  SELECT *, 'average' AS variant, avg2 AS demand, CAST(NULL AS DOUBLE) AS used_ml FROM latest
  UNION ALL SELECT *, 'forecast', COALESCE(ml, avg2), ml FROM latest),
rounded_cover AS (
  SELECT *, CASE WHEN demand IS NULL OR demand = 0 THEN NULL ELSE closing_stock / demand END AS cover,
    CAST(COALESCE(demand, 0) AS DECIMAL(18, 2)) AS d FROM variants),
rounded AS (
  SELECT variant, date, location, item, opening_stock, received, issued, closing_stock, lead_time_days,
    avg2 AS avg_daily_issue, used_ml AS ml_forecasted_demand, demand AS estimated_daily_demand, cover AS days_of_cover,
    CASE WHEN cover IS NULL THEN 'unknown' WHEN cover <= 2 THEN 'red' WHEN cover <= 5 THEN 'orange' ELSE 'green' END AS status,
    CASE WHEN closing_stock IS NULL THEN NULL ELSE round_even(CAST(GREATEST(0, 5 * d - closing_stock) AS DOUBLE), 0) END AS suggested_reorder,
    cover - lead_time_days AS urgency_score,
    CASE WHEN cover IS NULL OR lead_time_days IS NULL THEN 'Unknown' WHEN cover <= 0 THEN 'Critical'
         WHEN cover - lead_time_days <= 0 THEN 'High' WHEN cover < 2 THEN 'High'
         WHEN cover <= lead_time_days + 1 THEN 'High' WHEN cover <= 5 THEN 'Medium' ELSE 'Low' END AS priority,
    CASE WHEN closing_stock IS NULL THEN NULL ELSE round_even(CAST(GREATEST(0, closing_stock - 30 * d) AS DOUBLE), 0) END AS potential_waste,
    round_even(CAST((5 + lead_time_days) * d AS DOUBLE), 0) AS optimal_stock
  FROM rounded_cover),
attached AS (
  SELECT m.*, f.ml_forecasted_demand, COALESCE(f.ml_forecasted_demand, m.avg_daily_issue) AS estimated_daily_demand
  FROM metrics m LEFT JOIN forecast f ON f.location = m.location AND f.item = m.item),
orders AS (
  SELECT CASE WHEN rank <= 1 THEN 'High' ELSE priority END AS priority, item, location, suggested_reorder,
    days_of_cover, lead_time_days, CASE WHEN rank <= 1 THEN 1 ELSE rank END AS rank
  FROM at_risk WHERE suggested_reorder > 0),
lines AS (
  SELECT status, days_of_cover, location, item,
    '- ' || item || ' at ' || location || CASE status WHEN 'red' THEN ': Only ' ELSE ': ' END
      || CAST(CAST(ROUND(days_of_cover, 1) AS DECIMAL(18, 1)) AS VARCHAR) || ' days left, reorder '
      || CAST(CAST(ROUND(suggested_reorder, 1) AS DECIMAL(18, 1)) AS VARCHAR) || ' units' AS line,
    ROW_NUMBER() OVER (PARTITION BY status ORDER BY days_of_cover, location, item) AS pos
  FROM metrics WHERE status IN ('red', 'orange') AND days_of_cover IS NOT NULL),
facts AS (
  SELECT location, item,
    'Current stock: ' || CAST(closing_stock AS VARCHAR) || ' units' || chr(10)
    || 'Days of cover remaining: ' || CAST(CAST(ROUND(days_of_cover, 1) AS DECIMAL(18, 1)) AS VARCHAR) || ' days' || chr(10)
    || 'Average daily consumption: ' || CAST(CAST(ROUND(avg_daily_issue, 2) AS DECIMAL(18, 2)) AS VARCHAR) || ' units/day' || chr(10)
    || 'Lead time: ' || CAST(lead_time_days AS VARCHAR) || ' days' || chr(10)
    || 'Suggested reorder: ' || CAST(CAST(ROUND(suggested_reorder, 1) AS DECIMAL(18, 1)) AS VARCHAR) || ' units' || chr(10)
    || 'Priority: ' || priority || chr(10)
    || 'Urgency score: ' || CAST(CAST(ROUND(urgency_score, 1) AS DECIMAL(18, 1)) AS VARCHAR)
    || ' (negative means critical)' || chr(10) || chr(10)
    || 'Provide a clear, actionable explanation for procurement teams.' AS text
  FROM metrics),
app_lines AS (
  SELECT *, '- **' || item || '** at ' || location || ': ' || CASE status WHEN 'red' THEN 'Only ' ELSE '' END
      || printf('%.1f', days_of_cover) || ' days remaining. Recommended reorder: **'
      || CAST(CAST(TRUNC(suggested_reorder) AS BIGINT) AS VARCHAR) || ' units**' AS line,
    ROW_NUMBER() OVER (PARTITION BY status ORDER BY rank, days_of_cover, location, item) AS pos
  FROM at_risk),
app_text AS (
  SELECT COUNT(*) AS n, COUNT(*) FILTER (status = 'red') AS n_red, COUNT(*) FILTER (status = 'orange') AS n_orange,
    string_agg(line, chr(10) ORDER BY pos) FILTER (status = 'red') AS red_text,
    string_agg(line, chr(10) ORDER BY pos) FILTER (status = 'orange' AND pos <= 3) AS orange_text
  FROM app_lines),
app_summary AS (
  SELECT CASE WHEN n = 0 THEN '✅ All items are well-stocked. No immediate action required.'
    WHEN n_red + n_orange = 0 THEN '✅ All items are well-stocked.'
    ELSE CASE WHEN n_red > 0 THEN '🚨 **' || n_red || ' critical item(s)** require immediate attention' || chr(10) || red_text ELSE '' END
      || CASE WHEN n_red > 0 AND n_orange > 0 THEN chr(10) ELSE '' END
      || CASE WHEN n_orange > 0 THEN chr(10) || '⚠️ **' || n_orange || ' item(s)** need attention soon' || chr(10) || orange_text ELSE '' END
    END AS summary_text FROM app_text),
supp AS (SELECT *, CAST(substring(location, 10) AS BIGINT) AS suppkey FROM stock_daily),
old_stock AS (SELECT * FROM supp WHERE suppkey % 10 <> 0),
new_stock AS (SELECT * REPLACE (CASE WHEN suppkey % 10 = 2 THEN closing_stock + 1 ELSE closing_stock END AS closing_stock,
    CASE suppkey % 10 WHEN 3 THEN issued + 1 WHEN 5 THEN NULL ELSE issued END AS issued,
    CASE WHEN suppkey % 10 = 4 THEN lead_time_days + 1 ELSE lead_time_days END AS lead_time_days)
  FROM supp WHERE suppkey % 10 <> 1),
refreshes(step, minutes, back_days) AS (VALUES (0, 0, 90), (1, 30, 60), (2, 60, 30), (3, 100, 0)),
critical AS (
  SELECT now + to_minutes(step.minutes) AS ts, s.location, s.item, s.days_of_cover, s.closing_stock, s.suggested_reorder
  FROM clock CROSS JOIN (
    SELECT r.step, r.minutes, d.location, d.item, MAX(d.date) AS date FROM stock_daily d
    JOIN refreshes r ON d.date <= (SELECT MAX(date) FROM stock_daily) - r.back_days GROUP BY ALL) step
  JOIN scored s ON s.location = step.location AND s.item = step.item AND s.date = step.date
  WHERE s.days_of_cover <= 2),
alarms AS (
  SELECT location, item, MIN(ts) AS ts FROM critical GROUP BY location, item
  UNION ALL
  SELECT a.location, a.item, MIN(c.ts) FROM alarms a
  JOIN critical c ON c.location = a.location AND c.item = a.item AND c.ts >= a.ts + INTERVAL 1 HOUR
  GROUP BY a.location, a.item),
observed AS (
  SELECT action_id, action_timestamp AS ts, CASE WHEN CAST(substring(location, 10) AS BIGINT) % 7 <> 3 THEN location END AS location,
    item, days_of_cover, suggested_reorder
  FROM action_logs WHERE priority = 'Critical'),
chain AS (
  SELECT location, item, MIN(ts) AS ts FROM observed GROUP BY location, item
  UNION ALL
  SELECT c.location, c.item, MIN(o.ts) FROM chain c
  JOIN observed o ON o.location IS NOT DISTINCT FROM c.location AND o.item = c.item AND o.ts >= c.ts + INTERVAL 1 HOUR
  GROUP BY c.location, c.item)
"""

ORACLES: dict[str, str] = {}


def _r(*names: str) -> str:
    """Doubles to six places, negative zero folded into zero."""
    return ", ".join(f"ROUND({n}, 6) + 0 AS {n}" for n in names)


def _add(name: str, body: str) -> None:
    ORACLES[name] = f"{_PREFIX}\n{body.strip()}"


_DAILY = "date, location, item, opening_stock, received, issued, closing_stock, lead_time_days"
_METRICS = (
    "date, location, item, closing_stock, " + _r("avg_daily_issue", "days_of_cover") + ", lead_time_days, status, "
    + _r("suggested_reorder", "urgency_score") + ", priority, " + _r("potential_waste", "optimal_stock")
)
_ROUNDED = (
    f"{_DAILY}, " + _r("avg_daily_issue", "ml_forecasted_demand", "estimated_daily_demand", "days_of_cover")
    + ", status, " + _r("suggested_reorder", "urgency_score") + ", priority, " + _r("potential_waste", "optimal_stock")
)
_FORECAST = _r("ml_forecasted_demand", "estimated_daily_demand")
_BY_RISK = "ORDER BY rank, days_of_cover NULLS LAST, location, item"
_LOG = "action_id, action_timestamp, user_id, action_type, location, item, priority, days_of_cover, suggested_reorder"

# --- sources, sinks, contracts
for _name in ("src_csv", "src_table", "src_seed", "ingest_append"):
    _add(_name, f"SELECT {_DAILY} FROM stock_daily")
_add("src_coerce", f"""
SELECT location, item, CAST(closing_stock AS DOUBLE) AS closing_stock,
  CASE WHEN status = 'red' THEN NULL ELSE ROUND(avg_daily_issue, 6) END AS avg_daily_issue,
  CASE WHEN lead_time_days % 2 = 1 THEN NULL ELSE CAST(lead_time_days AS DOUBLE) END AS lead_time_days FROM metrics""")
_add("src_resolve", f"""
SELECT date, location, item, CAST(closing_stock AS DOUBLE) AS closing_stock, {_r("avg_daily_issue", "days_of_cover")},
  CAST(lead_time_days AS DOUBLE) AS lead_time_days, status, {_r("suggested_reorder", "urgency_score")}, priority,
  {_r("potential_waste", "optimal_stock")}, {_FORECAST}, 'view' AS source FROM attached""")
_add("ingest_validate", """
SELECT 'received' AS missing_columns, COUNT(*) AS row_count, COUNT(*) FILTER (suppkey % 10 IN (3, 4)) AS bad_rows FROM supp""")
_add("ingest_quarantine", """
SELECT CASE suppkey % 10 WHEN 5 THEN head WHEN 6 THEN head || ',' || lead || ',x' ELSE head || ',' || lead END AS line,
  CASE suppkey % 10 WHEN 3 THEN 'issued: n/a' WHEN 4 THEN 'date: soon' ELSE 'number of fields' END AS reason, CAST(NULL AS BIGINT) AS n
FROM (SELECT suppkey, COALESCE(CAST(lead_time_days AS VARCHAR), '') AS lead,
    CASE suppkey % 10 WHEN 4 THEN 'soon' ELSE CAST(date AS VARCHAR) END || ',' || location || ',' || item || ',' || opening_stock || ',' || received
    || ',' || CASE suppkey % 10 WHEN 3 THEN 'n/a' ELSE CAST(issued AS VARCHAR) END || ',' || closing_stock AS head FROM supp)
WHERE suppkey % 10 BETWEEN 3 AND 6
UNION ALL SELECT location, 'loaded', COUNT(*) FROM supp WHERE suppkey % 10 NOT BETWEEN 3 AND 6 GROUP BY location""")
_add("export_priority", f"SELECT {_METRICS} FROM at_risk")
_add("export_po", f"SELECT priority, item, location, {_r('suggested_reorder')}, lead_time_days FROM orders")
_add("dq_contract", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, TRUE AS present, COUNT({c}) AS rows_with_value FROM metrics"
    for c in ("date", "location", "item", "closing_stock", "avg_daily_issue", "days_of_cover", "lead_time_days", "status",
              "suggested_reorder", "urgency_score", "priority", "potential_waste", "optimal_stock")))
_add("dq_profile", """
SELECT COUNT(*) AS row_count, MIN(date) AS min_date, MAX(date) AS max_date, COUNT(DISTINCT location) AS locations,
  COUNT(DISTINCT item) AS items FROM stock_daily""")
_add("dq_row_counts", """
SELECT 'stock_daily' AS table_name, COUNT(*) AS row_count FROM stock_daily
UNION ALL SELECT 'inventory_metrics', COUNT(*) FROM metrics UNION ALL SELECT 'inventory_at_risk', COUNT(*) FROM at_risk
UNION ALL SELECT 'action_logs', COUNT(*) FROM action_logs
UNION ALL SELECT 'critical_items_alerts', COUNT(*) FROM action_logs WHERE action_type = 'ACKNOWLEDGE_ALERT'""")
_add("dq_footers", """
SELECT 'stock_daily' AS table_name, COUNT(*) AS row_count, MIN(date) AS min_date, MAX(date) AS max_date FROM stock_daily
UNION ALL SELECT 'action_logs', COUNT(*), CAST(NULL AS DATE), CAST(NULL AS DATE) FROM action_logs""")
_add("dq_enums", """
SELECT 'action_type' AS column_name, 'TEST_ACTION' AS bad_value, COUNT(*) AS n FROM action_logs WHERE user_id LIKE '%7'
UNION ALL SELECT 'status', 'DONE', COUNT(*) FROM action_logs WHERE action_id % 11 = 0""")

# --- metrics
_add("rolling_issue", "SELECT location, item, date, issued, ROUND(avg_issue, 6) AS avg_daily_issue FROM usage")
_add("days_of_cover", f"SELECT location, item, closing_stock, {_r('avg_daily_issue', 'days_of_cover')} FROM metrics")
_add("status_band", f"SELECT location, item, {_r('days_of_cover')}, status FROM metrics")
for _name in ("suggested_reorder", "urgency_score", "potential_waste"):
    _add(_name, f"SELECT location, item, {_r(_name)} FROM metrics")
_add("priority", f"SELECT location, item, {_r('days_of_cover')}, lead_time_days, priority FROM metrics")
_add("optimal_stock", f"SELECT location, item, lead_time_days, {_r('optimal_stock')} FROM metrics")
_add("latest_per_pair", f"SELECT {_DAILY} FROM usage WHERE back = 1")
_add("metrics", f"SELECT {_METRICS} FROM metrics")
_add("at_risk", f"SELECT {_METRICS} FROM at_risk")
_add("metrics_history", f"""
SELECT location, item, closing_stock, {_r("avg_daily_issue", "days_of_cover")}, lead_time_days, status,
  {_r("suggested_reorder")} FROM scored""")
_add("quick_priority", """
SELECT location, item, CASE WHEN days_of_cover IS NULL OR lead_time_days IS NULL THEN 'Unknown'
  WHEN days_of_cover <= 0 THEN 'Critical' WHEN urgency_score <= 0 THEN 'High' WHEN days_of_cover < 2 THEN 'High'
  ELSE 'Medium' END AS priority FROM metrics""")
_add("metrics_rounded", f"SELECT {_ROUNDED} FROM rounded WHERE variant = 'average'")
_add("band", f"""
SELECT location, item, {_r("days_of_cover")}, CASE WHEN days_of_cover IS NULL THEN 'unknown'
  WHEN days_of_cover <= 2 THEN 'red' WHEN days_of_cover <= 5 THEN 'orange' ELSE 'green' END AS band FROM metrics""")

# --- forecast
_add("last_n", "SELECT location, item, date, issued, -back AS day_num FROM history")
_add("trend_slope", f"SELECT location, item, history_rows, {_r('avg_issued', 'trend_slope')} FROM fit")
_add("forecast", f"SELECT location, item, {_r('ml_forecasted_demand')} FROM forecast")
_add("est_demand", f"""
SELECT location, item, {_r("avg_daily_issue", "ml_forecasted_demand", "estimated_daily_demand")}
FROM rounded WHERE variant = 'forecast'""")
_add("metrics_forecast", f"SELECT {_ROUNDED} FROM rounded WHERE variant = 'forecast'")
_add("attach_forecast", f"SELECT {_METRICS}, {_FORECAST} FROM attached")
_add("forecast_compare", f"""
SELECT location, item, {_r("avg_daily_issue", "ml_forecasted_demand", "estimated_daily_demand")},
  round_even((ml_forecasted_demand - avg_daily_issue) / NULLIF(avg_daily_issue, 0) * 100, 1) + 0 AS forecast_change
FROM attached WHERE ml_forecasted_demand > 0""")

# --- reports
_add("kpis", """
SELECT total_items, at_risk_items, critical_items, total_items - at_risk_items AS healthy_items,
  ROUND(CASE WHEN total_items > 0 THEN (total_items - at_risk_items) * 100.0 / total_items ELSE 0 END, 6)::DOUBLE AS health_pct
FROM (SELECT COUNT(*) AS total_items, COUNT(*) FILTER (days_of_cover IS NULL OR days_of_cover <= 5) AS at_risk_items,
        COUNT(*) FILTER (days_of_cover < 2) AS critical_items FROM metrics)""")
_add("location_health", """
SELECT *, ROW_NUMBER() OVER (ORDER BY critical_count DESC, location) AS pos FROM (
  SELECT location, COUNT(*) FILTER (days_of_cover IS NULL OR days_of_cover <= 5) AS at_risk_count,
    COUNT(*) FILTER (status = 'red') AS critical_count FROM metrics GROUP BY location)""")
_add("item_health", """
SELECT *, ROW_NUMBER() OVER (ORDER BY critical_locations DESC, item) AS pos FROM (
  SELECT item, COUNT(*) FILTER (days_of_cover IS NULL OR days_of_cover <= 5) AS at_risk_locations,
    COUNT(*) FILTER (status = 'red') AS critical_locations, ROUND(SUM(suggested_reorder), 6) AS total_reorder
  FROM metrics GROUP BY item)""")
_add("dims", """
SELECT dimension, value, ROW_NUMBER() OVER (ORDER BY dimension, value) AS pos FROM (
  SELECT 'location' AS dimension, location AS value FROM metrics UNION SELECT 'item', item FROM metrics)""")
_add("slice_metrics", f"""
SELECT {_METRICS} FROM metrics WHERE location IN (SELECT s_name FROM supplier WHERE s_acctbal > 0)
  AND item IN ('ECONOMY', 'PROMO', 'SMALL')""")
_add("quick_actions", f"""
SELECT {_METRICS}, pos FROM (SELECT *, ROW_NUMBER() OVER ({_BY_RISK}) AS pos FROM metrics
  WHERE days_of_cover IS NULL OR days_of_cover <= 2) WHERE pos <= 5""")
_add("at_risk_list", f"""
SELECT {_METRICS}, ROW_NUMBER() OVER ({_BY_RISK}) AS pos FROM metrics WHERE days_of_cover IS NULL OR days_of_cover <= 7.5""")
_add("priority_counts", """
SELECT p.priority, COUNT(a.item) AS n FROM (VALUES ('Critical'), ('High'), ('Medium'), ('Low')) AS p(priority)
LEFT JOIN at_risk a ON a.priority = p.priority GROUP BY p.priority""")
_add("priority_rank", "SELECT location, item, priority, CAST(rank AS BIGINT) AS priority_rank FROM metrics")
_add("waste_summary", """
SELECT ROUND(SUM(potential_waste), 6) AS total_waste, COUNT(*) FILTER (potential_waste > 0) AS overstocked_items FROM metrics""")
_add("overstock", f"""
SELECT location, item, closing_stock, {_r("optimal_stock", "potential_waste")},
  ROW_NUMBER() OVER (ORDER BY potential_waste DESC, location, item) AS pos FROM metrics WHERE potential_waste > 0""")
_add("purchase_orders", f"""
SELECT priority, item, location, {_r("suggested_reorder", "days_of_cover")}, lead_time_days,
  ROW_NUMBER() OVER ({_BY_RISK}) AS pos FROM orders""")
_add("heatmap_long", f"""
SELECT location, item, status, closing_stock, {_r("days_of_cover", "suggested_reorder", "avg_daily_issue")} FROM metrics""")
_add("heatmap_wide", "SELECT location, " + ", ".join(
    f"MAX(status) FILTER (item = '{i}') AS \"{i}\"" for i in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
) + " FROM metrics GROUP BY location")
_add("trend_change", """
SELECT a.location, a.item, a.closing_stock AS latest_stock, b.closing_stock AS previous_stock,
  a.closing_stock - b.closing_stock AS stock_change,
  ROUND(CASE WHEN b.closing_stock > 0 THEN (a.closing_stock - b.closing_stock)::DOUBLE * 100.0 / b.closing_stock ELSE 0 END, 6) + 0 AS change_pct
FROM usage a JOIN usage b ON a.location = b.location AND a.item = b.item AND a.back = 1 AND b.back = 2""")
_add("trend_direction", """
SELECT location, item, ROUND(recent, 6) AS recent_avg, ROUND(earlier, 6) AS earlier_avg,
  CASE WHEN recent > earlier THEN 'Improving' ELSE 'Declining' END AS direction FROM (
  SELECT location, item, AVG(closing_stock) FILTER (back <= 3) AS recent, AVG(closing_stock) FILTER (ahead <= 3) AS earlier
  FROM usage WHERE n >= 3 GROUP BY location, item)""")
_add("trend_series", """
SELECT date, closing_stock, received, issued, opening_stock, ROW_NUMBER() OVER (ORDER BY date) AS pos
FROM stock_daily WHERE location = 'Supplier#000000001' AND item = 'PROMO'""")
_add("inventory_status", """
SELECT CAST(SUM(received) AS BIGINT) AS total_received, CAST(SUM(opening_stock) AS BIGINT) AS total_opening_stock,
  CAST(SUM(closing_stock) AS BIGINT) AS total_closing_stock, MIN(date) AS first_date, MAX(date) AS last_date,
  (SELECT COUNT(*) FROM metrics) AS pairs, (SELECT COUNT(DISTINCT location) FROM metrics) AS locations,
  (SELECT COUNT(DISTINCT item) FROM metrics) AS items FROM stock_daily""")
_add("usage_status", """
SELECT CAST(SUM(issued) AS BIGINT) AS total_issued, COUNT(DISTINCT date) AS days_of_data,
  (SELECT ROUND(AVG(avg_daily_issue), 6) FROM metrics) AS avg_consumption,
  (SELECT COUNT(*) FROM metrics WHERE avg_daily_issue > 0) AS items_with_usage FROM stock_daily""")
_add("po_status", """
SELECT ROUND(CAST(SUM(lead_time_days) AS DOUBLE) / COUNT(*), 6) AS avg_lead_time,
  COUNT(*) FILTER (days_of_cover IS NULL OR days_of_cover <= 5) AS reorder_recommendations,
  COUNT(lead_time_days) AS items_with_lead_time FROM metrics""")

# --- action log
_NEW_LOG = """(SELECT MAX(action_id) FROM action_logs) + ROW_NUMBER() OVER ({order}) AS action_id,
  (SELECT now FROM clock) AS action_timestamp, 'local_user' AS user_id"""
_add("log_actions", f"""
SELECT {_NEW_LOG.format(order="ORDER BY location, item")}, 'ACKNOWLEDGE_ALERT' AS action_type, location, item,
  CAST(NULL AS VARCHAR) AS action_details, priority, {_r("days_of_cover", "suggested_reorder")}, 'PENDING' AS status FROM at_risk""")
_add("log_actions_writers", """
SELECT ROW_NUMBER() OVER (ORDER BY action_id % 2, action_id) AS pos, 'writer_' || (action_id % 2) AS user_id, action_type, location, item, status,
  CAST(0 AS BIGINT) AS repeated_ids FROM action_logs""")
_add("action_json", """
SELECT action_id, CAST(json_extract_string(action_details, '$.k') AS BIGINT) AS k,
  CAST(json(action_details) AS VARCHAR) AS action_details FROM action_logs""")
_add("action_details_build", """
SELECT location, item, date, CAST(json_object('source', 'manual_input', 'date', CAST(date AS VARCHAR),
  'opening_stock', opening_stock, 'received', received, 'issued', issued, 'closing_stock', closing_stock,
  'entered_by', 'local_user') AS VARCHAR) AS action_details FROM stock_daily""")
_add("actions_top_n", f"""
SELECT {_LOG}, status, action_details, pos FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY action_timestamp DESC, action_id DESC) AS pos FROM action_logs) WHERE pos <= 50""")
_add("recent_actions", f"""
SELECT {_LOG}, status, action_details, ROW_NUMBER() OVER (ORDER BY action_timestamp DESC, action_id DESC) AS pos
FROM action_logs WHERE action_timestamp >= (SELECT now FROM clock) - INTERVAL 24 HOUR""")
_SUMMARY = """SELECT action_type, COUNT(*) AS action_count, COUNT(DISTINCT location || '|' || item) AS unique_items_acted_upon,
    MIN(action_timestamp) AS first_action, MAX(action_timestamp) AS last_action FROM action_logs GROUP BY action_type"""
_add("action_summary", f"SELECT *, ROW_NUMBER() OVER (ORDER BY action_count DESC, action_type) AS pos FROM ({_SUMMARY})")
_add("pending_actions", f"""
SELECT {_LOG}, action_details, ROW_NUMBER() OVER (ORDER BY CASE priority WHEN 'Critical' THEN 1 WHEN 'High' THEN 2
    WHEN 'Medium' THEN 3 WHEN 'Low' THEN 4 ELSE 5 END, action_timestamp DESC, action_id DESC) AS pos
FROM action_logs WHERE status = 'PENDING'""")
_add("action_totals", f"SELECT CAST(SUM(action_count) AS BIGINT) AS total_actions, COUNT(*) AS action_types FROM ({_SUMMARY})")
_add("log_po_export", f"""
SELECT {_NEW_LOG.format(order=_BY_RISK)}, 'EXPORT_CSV' AS action_type, location, item,
  '{{"export_type":"purchase_orders","total_pos":' || (SELECT COUNT(*) FROM orders) || '}}' AS action_details, priority,
  CAST(NULL AS DOUBLE) AS days_of_cover, {_r("suggested_reorder")}, 'COMPLETED' AS status FROM orders""")
_add("log_priority_export", f"""
SELECT * FROM (SELECT {_NEW_LOG.format(order=_BY_RISK)}, 'EXPORT_CSV' AS action_type, location, item,
  '{{"export_type":"priority_list","total_items":' || (SELECT COUNT(*) FROM at_risk) || '}}' AS action_details, priority,
  {_r("days_of_cover", "suggested_reorder")}, 'COMPLETED' AS status FROM at_risk)
WHERE action_id <= (SELECT MAX(action_id) FROM action_logs) + 10""")
_LOG_AS_IS = "a.action_id, a.action_timestamp, a.user_id, a.action_type, a.location, a.item, a.action_details, a.priority, a.status"
_add("enrich_actions", f"""
SELECT {_LOG_AS_IS}, ROUND(m.days_of_cover, 6) AS days_of_cover, ROUND(m.suggested_reorder, 6) AS suggested_reorder
FROM action_logs a JOIN metrics m ON m.location = a.location AND m.item = a.item""")
_add("refused_actions", f"""
SELECT {_LOG_AS_IS}, ROUND(a.days_of_cover, 6) AS days_of_cover, ROUND(a.suggested_reorder, 6) AS suggested_reorder
FROM action_logs a WHERE NOT EXISTS (SELECT 1 FROM metrics m WHERE m.location = a.location AND m.item = a.item)""")

# --- narrative
_add("risk_lines", "SELECT status, pos, line FROM lines")
_add("summary_prompt", """
SELECT 'Analyze this inventory situation and provide a concise, actionable summary for procurement teams:' || chr(10) || chr(10)
  || 'Critical items (red status):' || chr(10)
  || COALESCE((SELECT string_agg(line, chr(10) ORDER BY pos) FROM lines WHERE status = 'red'), 'None') || chr(10) || chr(10)
  || 'Warning items (orange status):' || chr(10)
  || COALESCE((SELECT string_agg(line, chr(10) ORDER BY pos) FROM lines WHERE status = 'orange'), 'None') || chr(10) || chr(10)
  || 'Provide a brief, professional summary highlighting priorities and recommended actions.' AS prompt""")
_add("summary_prompt_lines", """
SELECT CAST(section AS INT) AS section, CAST(pos AS BIGINT) AS pos, line FROM (
  SELECT 0 AS section, 0 AS pos, 'Analyze this inventory situation and provide a concise, actionable summary for procurement teams:' AS line
  UNION ALL SELECT 1, 0, 'Critical items (red status):' UNION ALL SELECT 2, 0, 'Warning items (orange status):'
  UNION ALL SELECT 3, 0, 'Provide a brief, professional summary highlighting priorities and recommended actions.'
  UNION ALL SELECT CASE status WHEN 'red' THEN 1 ELSE 2 END, pos, line FROM lines
  UNION ALL SELECT 1, 1, 'None' WHERE NOT EXISTS (SELECT 1 FROM lines WHERE status = 'red')
  UNION ALL SELECT 2, 1, 'None' WHERE NOT EXISTS (SELECT 1 FROM lines WHERE status = 'orange'))""")
_EXPLAIN = """'Explain why this inventory item needs reordering in simple terms:' || chr(10) || chr(10) || 'Item: ' || q.item
  || chr(10) || 'Location: ' || q.location || chr(10) || COALESCE(f.text, 'Item not found in inventory metrics.') AS explanation"""
_add("explain_reorder", f"""
SELECT q.location, q.item, {_EXPLAIN} FROM (
  SELECT location, item FROM metrics UNION ALL
  SELECT location, item || ' (old)' FROM metrics WHERE CAST(substring(location, 10) AS BIGINT) % 10 = 0) q
LEFT JOIN facts f ON f.location = q.location AND f.item = q.item""")
_add("text_functions", ORACLES["explain_reorder"].removeprefix(_PREFIX).replace("AS explanation", "AS text").replace(
    " WHERE CAST(substring(location, 10) AS BIGINT) % 10 = 0", "") + "\nUNION ALL SELECT 'all', 'all', ("
    + ORACLES["summary_prompt"].removeprefix(_PREFIX) + ")")
_add("explain_critical", f"""
SELECT q.location, q.item, ROUND(q.days_of_cover, 6) AS days_of_cover, ROUND(q.suggested_reorder, 6) AS suggested_reorder,
  {_EXPLAIN}, ROW_NUMBER() OVER (ORDER BY q.days_of_cover, q.location, q.item) AS pos
FROM metrics q JOIN facts f ON f.location = q.location AND f.item = q.item WHERE q.status = 'red'""")
_add("fallback_summary", "SELECT summary_text FROM app_summary")
_add("daily_summary", """
SELECT CAST(now AS DATE) AS summary_date, summary_text, now AS generated_at FROM app_summary CROSS JOIN clock""")

# --- change capture and streaming
# These two need the ledger alone: no recursive part, and no join of two large sides.
_STOCK = f"WITH stock_daily AS MATERIALIZED ({_LEDGER}),\nsupp AS (SELECT *, CAST(substring(location, 10) AS BIGINT) AS suppkey FROM stock_daily)"
ORACLES["snapshot_diff"] = f"""{_STOCK},
versions AS (
  SELECT 'old' AS version, date, location, item, closing_stock, [opening_stock, received, issued, closing_stock, lead_time_days] AS stock
  FROM supp WHERE suppkey % 10 <> 0
  UNION ALL
  SELECT 'new', date, location, item, closing_stock + CASE suppkey % 10 WHEN 2 THEN 1 ELSE 0 END,
    [opening_stock, received, CASE suppkey % 10 WHEN 3 THEN issued + 1 WHEN 5 THEN NULL ELSE issued END,
     closing_stock + CASE suppkey % 10 WHEN 2 THEN 1 ELSE 0 END, lead_time_days + CASE suppkey % 10 WHEN 4 THEN 1 ELSE 0 END]
  FROM supp WHERE suppkey % 10 <> 1),
sides AS (
  SELECT date, location, item, COUNT(*) FILTER (version = 'old') AS n_old, COUNT(*) FILTER (version = 'new') AS n_new,
    MAX(closing_stock) FILTER (version = 'old') AS old_closing_stock, MAX(closing_stock) FILTER (version = 'new') AS new_closing_stock,
    MAX(CAST(stock AS VARCHAR)) FILTER (version = 'old') AS old_row, MAX(CAST(stock AS VARCHAR)) FILTER (version = 'new') AS new_row
  FROM versions GROUP BY date, location, item)
SELECT CASE WHEN n_old = 0 THEN 'INSERT' WHEN n_new = 0 THEN 'DELETE' ELSE 'UPDATE' END AS change_type, date, location, item,
  old_closing_stock, new_closing_stock
FROM sides WHERE old_row IS DISTINCT FROM new_row"""
ORACLES["diff_versions"] = f"""
SELECT change_type, CAST(date_trunc('quarter', date) AS DATE) AS date, location, item || ' ' || CAST(date AS VARCHAR) AS item,
  old_closing_stock, new_closing_stock FROM ({ORACLES["snapshot_diff"]}) WHERE quarter(date) % 2 = 0"""
_CHANGE_LOG = f"""{_STOCK},
feed AS (
  SELECT location, item, date, closing_stock + v AS closing_stock, CAST(date AS TIMESTAMP) + v * INTERVAL 1 HOUR AS change_timestamp,
    CASE WHEN v = 3 AND suppkey % 9 = 8 THEN 'DELETE' WHEN v = 1 THEN 'INSERT' ELSE 'UPDATE' END AS change_type
  FROM supp, unnest(range(1, 2 + suppkey % 3)) AS t(v))
SELECT change_timestamp, location, item, date, change_type,
  LAG(closing_stock) OVER (PARTITION BY location, item, date ORDER BY change_timestamp) AS old_closing_stock, closing_stock AS new_closing_stock
FROM feed WHERE change_type <> 'DELETE'"""
_add("diff_change_log", """
SELECT now AS change_timestamp, location, item, date, 'INSERT' AS change_type, CAST(NULL AS BIGINT) AS old_closing_stock,
  closing_stock AS new_closing_stock FROM clock CROSS JOIN old_stock
UNION ALL
SELECT now + INTERVAL 1 HOUR, n.location, n.item, n.date, CASE WHEN o.date IS NULL THEN 'INSERT' ELSE 'UPDATE' END,
  o.closing_stock, n.closing_stock
FROM clock CROSS JOIN new_stock n LEFT JOIN old_stock o ON o.date = n.date AND o.location = n.location AND o.item = n.item
WHERE o.date IS NULL OR (o.opening_stock, o.received, o.issued, o.closing_stock, o.lead_time_days)
  IS DISTINCT FROM (n.opening_stock, n.received, n.issued, n.closing_stock, n.lead_time_days)""")
ORACLES["change_log"] = ORACLES["stream_change_log"] = _CHANGE_LOG
_add("new_alerts", f"""
SELECT now AS alert_timestamp, m.location, m.item, {_r("days_of_cover")}, closing_stock, {_r("suggested_reorder")}
FROM metrics m CROSS JOIN clock WHERE days_of_cover <= 2 AND NOT EXISTS (
  SELECT 1 FROM action_logs a WHERE a.action_type = 'ACKNOWLEDGE_ALERT' AND a.location = m.location AND a.item = m.item
    AND a.action_timestamp > now - INTERVAL 1 HOUR)""")
_add("stream_alerts", """
SELECT MIN(o.action_id) AS action_id, c.ts AS alert_timestamp, c.location, c.item,
  ROUND(arg_min(o.days_of_cover, o.action_id), 6) AS days_of_cover,
  ROUND(arg_min(o.suggested_reorder, o.action_id), 6) AS suggested_reorder
FROM chain c JOIN observed o ON o.location IS NOT DISTINCT FROM c.location AND o.item = c.item AND o.ts = c.ts GROUP BY c.location, c.item, c.ts""")
_add("stream_metrics", f"SELECT {_METRICS} FROM metrics")
_add("stream_at_risk", f"SELECT {_METRICS} FROM at_risk")
_add("alert_upkeep", f"""
SELECT a.ts AS alert_timestamp, a.location, a.item, {_r("days_of_cover")}, closing_stock, {_r("suggested_reorder")}
FROM alarms a JOIN critical c ON c.location = a.location AND c.item = a.item AND c.ts = a.ts""")
_add("refresh_history", """
SELECT CAST(step AS BIGINT) AS batch_id, COUNT(*) AS input_rows FROM (
  SELECT MIN(r.step) AS step FROM stock_daily d JOIN refreshes r ON d.date <= (SELECT MAX(date) FROM stock_daily) - r.back_days
  GROUP BY d.date, d.location, d.item) GROUP BY step""")
_STEPS = """SELECT CAST(step AS BIGINT) AS batch_id, COUNT(*) AS input_rows FROM (
  SELECT MIN(r.step) AS step FROM stock_daily d JOIN refreshes r ON d.date <= (SELECT MAX(date) FROM stock_daily) - r.back_days
  GROUP BY d.date, d.location, d.item) GROUP BY step"""
_add("refresh_log", f"""
SELECT 'inventory_metrics_dt' AS query_name, 'SUCCEEDED' AS state, batch_id, input_rows, FALSE AS failed FROM ({_STEPS})
UNION ALL SELECT 'inventory_metrics_dt', 'FINISHED', NULL, NULL, FALSE FROM refreshes""")
_add("refresh_status", f"""
SELECT 'inventory_metrics_dt' AS query_name, 'FINISHED' AS state, COUNT(*) AS epochs, CAST(0 AS BIGINT) AS failures,
  CAST(SUM(input_rows) AS BIGINT) AS input_rows, 30.0::DOUBLE AS lag_seconds, TRUE AS within_target FROM ({_STEPS})""")
_add("stream_rebuild", f"SELECT {_METRICS} FROM metrics")
_add("freshness", """
SELECT 'stock_daily' AS table_name, COUNT(*) AS row_count, MAX(date) AS data_date, CAST(0 AS BIGINT) AS days_behind FROM stock_daily
UNION ALL SELECT name, COUNT(*), MAX(date), date_diff('day', MAX(date), (SELECT MAX(date) FROM stock_daily))
FROM metrics CROSS JOIN (VALUES ('inventory_metrics'), ('inventory_metrics_dt')) AS t(name) GROUP BY name""")
