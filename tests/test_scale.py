"""Skewed keys and plan shapes."""
import random
from datetime import date, timedelta

import pytest
from helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockhealth.operators import actions as A
from stockhealth.operators import changes as CH
from stockhealth.operators import forecast as FC
from stockhealth.operators import metrics as M
from stockhealth.operators import reports as R
from stockhealth.operators.keyed import lookback, with_position
from stockhealth.policy import Policy
from stockhealth.schema import STOCK_CHANGES, STOCK_DAILY


@pytest.fixture(scope="module")
def skewed(spark):
    """One pair holds most rows, many of them on the same dates, many exact copies; some keys are null."""
    rng = random.Random(7)
    start = date(2024, 1, 1)

    def row(location, item, day, issued):
        return (start + timedelta(days=day), location, item, 0, 0, issued, rng.randint(0, 30), 3)

    data = [row("hot", "x", rng.randint(0, 40), rng.choice([None, 1, 2, 3, 9])) for _ in range(900)]
    data += [(start, "hot", "x", 0, 0, 5, 7, 3)] * 200
    data += [row(f"l{i % 5}", "y", i, i) for i in range(60)]
    data += [row(None, "x", i % 50, i) for i in range(300)]
    rng.shuffle(data)
    return spark.createDataFrame(data, STOCK_DAILY).repartition(5).cache()


def expected_rolling(skewed):
    """Brute force per pair in Python, in the documented order."""
    groups = {}
    for r in skewed.collect():
        groups.setdefault((r.location, r.item), []).append(r)

    def low(v):
        return (v is not None, v if v is not None else 0)

    out = []
    for pair, members in groups.items():
        members.sort(key=lambda r: (r.date, low(r.closing_stock), low(r.issued), low(r.lead_time_days)))
        for i, r in enumerate(members):
            seen = [m.issued for m in members[max(0, i - 6):i + 1] if m.issued is not None]
            out.append((*pair, r.date, r.closing_stock, r.issued, round(sum(seen) / len(seen), 9) if seen else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows", [1_000_000, 250, 40])
def test_rolling_over_split_groups(skewed, hot_rows):
    got = M.rolling_issue(skewed, Policy(hot_rows=hot_rows))
    got = got.select("location", "item", "date", "closing_stock", "issued", F.round("avg_daily_issue", 9))
    assert rows(got) == expected_rolling(skewed)


def test_split_groups_are_split(skewed):
    """No window partition holds more than about hot_rows rows of the hot pair."""
    sizes = []

    def spy(df, partition, order):
        sizes.append(df.groupBy(*partition).count().agg(F.max("count")).first()[0])
        return df.withColumn("avg_daily_issue", F.avg("issued").over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(-6, 0)))

    lookback(skewed, ["location", "item"], ["date", "closing_stock", "issued", "lead_time_days"], 6, "issued", spy, 100).count()
    assert len(sizes) == 2 and max(sizes) < 300


def test_snapshot_equals_last_history_row(skewed):
    """The cut-down snapshot gives what the full history gives for the newest row of each pair."""
    history = M.rolling_issue(skewed)
    newest = Window.partitionBy("location", "item").orderBy(
        F.col("date").desc(), *[F.col(c).desc_nulls_last() for c in M.SCORE_TIES])
    last = history.withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    cut = M.recent_usage(skewed)
    columns = ["location", "item", "date", "closing_stock", "avg_daily_issue"]
    assert rows(cut, *columns) == rows(last, *columns)


@pytest.mark.parametrize("since", [date(2023, 1, 1), date(2024, 1, 20), date(2024, 2, 18), date(2030, 1, 1)])
def test_since_is_only_a_hint(skewed, since):
    undated = skewed.unionByName(skewed.where("location = 'l1'").limit(2).withColumn("date", F.lit(None).cast("date"))).cache()
    for operator in (M.metrics, M.metrics_rounded, FC.metrics_forecast, FC.trend):
        assert rows(operator(undated, since=since)) == rows(operator(undated)), operator


def test_since_drops_old_rows_before_the_exchange(daily):
    text = plan(M.metrics(daily, since=date(2001, 6, 1)))
    assert "LeftAnti" in text and "SortMergeJoin" not in text
    assert "GreaterThanOrEqual(date,2001-06-01)" in text


def changes(spark, n=400):
    rng = random.Random(3)
    day = date(2024, 1, 1)
    data = []
    for i in range(n):
        key = ("hot", "x", day) if i % 3 else (f"l{i % 7}", "y", day)
        data.append((f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", *key, rng.choice(["INSERT", "UPDATE", "DELETE"]), rng.randint(0, 99)))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "t string, location string, item string, date date, change_type string, closing_stock long")
    return df.select(F.col("t").cast("timestamp_ntz").alias("change_timestamp"), *STOCK_CHANGES.fieldNames()[1:])


def test_change_log_over_split_groups(spark):
    feed = changes(spark)
    plain, split = CH.change_log(feed), CH.change_log(feed, Policy(hot_rows=30))
    assert rows(plain) == rows(split)
    last = {}
    expected = []
    for r in sorted(feed.collect(), key=lambda r: r.change_timestamp):
        if r.change_type != "DELETE":
            key = (r.location, r.item, r.date)
            expected.append((r.change_timestamp, *key, r.change_type, last.get(key), r.closing_stock))
            last[key] = r.closing_stock
    assert rows(plain) == sorted(expected, key=repr)


def test_positions(spark, skewed):
    unique = skewed.withColumn("id", F.monotonically_increasing_id())
    numbered = with_position(unique, [F.col("item").asc(), F.col("date").desc(), F.col("id").asc()])
    got = [(r.item, r.date, r.id) for r in numbered.orderBy("pos").collect()]
    assert [r.pos for r in numbered.orderBy("pos").collect()] == list(range(1, unique.count() + 1))
    assert got == sorted(got, key=lambda r: (r[0], -r[1].toordinal(), r[2]))
    assert with_position(unique.where("false"), [F.col("id").asc()]).count() == 0


def test_log_ids_continue(spark, actions):
    top = actions.agg(F.max("action_id")).first()[0]
    new = actions.select("action_type", "location", "item")
    logged = A.log_actions(new, actions, user="u", as_of=None)
    ids = sorted(r.action_id for r in logged.select("action_id").collect())
    assert ids == list(range(top + 1, top + 1 + actions.count()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("operator", [M.metrics, M.metrics_rounded, FC.forecast, FC.metrics_forecast, R.trend_change, M.latest_per_pair])
def test_one_exchange_after_a_map_side_cut(daily, operator):
    text = plan(operator(daily))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Exchange") == 1
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")
    assert "Python" not in text and "Pandas" not in text


def test_scan_reads_needed_columns_only(daily):
    assert "ReadSchema: struct<date:date,location:string,item:string,closing_stock:bigint>" in plan(R.trend_change(daily))
    series = plan(R.trend_series(daily, "a", "b"))
    assert "EqualTo(location,a), EqualTo(item,b)" in series


def test_top_n_is_not_a_full_sort(actions, daily):
    assert "TakeOrderedAndProject" in plan(A.load_actions(actions, 50))
    assert "TakeOrderedAndProject" in plan(R.quick_actions(M.metrics(daily)))


def test_time_filter_is_pushed_down(actions):
    from datetime import datetime

    recent = plan(A.recent_actions(actions, datetime(2024, 1, 30)))
    assert "GreaterThanOrEqual(action_timestamp,2024-01-29T00:00)" in recent
