"""Hand-made edge rows for the feature pipeline's operators, with expected values written out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers, times
from tidemark.operators import features, joins, records, serving, text, training

UTC = dt.timezone.utc


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


def trades(spark, rows):
    """(ts, price[, size[, ticker]])"""
    full = [(i, r[3] if len(r) > 3 else "A", at(r[0]), float(r[1]), float(r[2] if len(r) > 2 else 1), False) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "event_id long, ticker string, ts timestamp, price double, size double, simulated boolean")


def one(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_single_point_window(spark):
    out = features.trailing_features(trades(spark, [("2024-01-02T15:00:00", 10, 7)]), {"1min": 60})
    assert one(out, "price_mean_1min", "price_std_1min", "size_tot_1min") == [(10.0, 0.0, 7.0)]


def test_trailing_frame_is_closed_and_keeps_to_the_iso_week(spark):
    t = trades(spark, [("2023-12-31T23:59:50", 1), ("2024-01-01T00:00:00", 2), ("2024-01-01T00:01:00", 4), ("2024-01-01T00:02:00.000001", 8)])
    out = features.trailing_features(t, {"1min": 60}).orderBy("ts")
    assert [x for (x,) in one(out, "price_mean_1min")] == [1.0, 2.0, 3.0, 8.0]


def test_grid_carries_means_over_empty_windows(spark):
    t = trades(spark, [("2024-01-02T10:00:00", 10, 3), ("2024-01-02T10:02:05", 20, 4)])
    out = {r["ts"].minute * 60 + r["ts"].second: r for r in features.grid_features(t, 10, {"1min": 60}).collect()}
    assert (out[10]["price_mean_1min"], out[10]["size_tot_1min"]) == (10.0, 3.0)
    assert (out[60]["price_mean_1min"], out[60]["size_tot_1min"]) == (10.0, 3.0)
    assert (out[120]["price_mean_1min"], out[120]["size_tot_1min"]) == (10.0, 0.0)
    assert (out[130]["price_mean_1min"], out[130]["size_tot_1min"]) == (20.0, 4.0)


@pytest.mark.parametrize("prices, want", [((100, 103), 3.0), ((103, 100), -3.0)])
def test_spikes(spark, prices, want):
    t = trades(spark, [("2024-01-02T10:00:01", prices[0]), ("2024-01-02T10:00:21", prices[1])])
    assert one(features.price_spikes(t, 2.0), "price_difference") == [(want,)]
    assert one(features.price_spikes(t, 3.0), "price_difference") == []


def test_spikes_take_the_earliest_of_tied_extremes(spark):
    t = trades(spark, [("2024-01-02T10:00:01", 5), ("2024-01-02T10:00:02", 9), ("2024-01-02T10:00:03", 5), ("2024-01-02T10:00:04", 9)])
    (r,) = features.price_spikes(t, 1.0).collect()
    assert (r["min_timestamp"].second, r["max_timestamp"].second) == (1, 2)


def test_session_edges(spark):
    edges = ["09:29:59", "09:30:00", "15:58:59", "15:59:00", "15:59:59", "16:00:00"]
    t = trades(spark, [(f"2024-01-03T{int(e[:2]) + 5:02d}{e[2:]}", 1) for e in edges] + [("2024-01-06T17:00:00", 1)])
    out = t.orderBy("event_id").select(times.in_session("ts").alias("p3"), times.in_session("ts", end="15:59").alias("p4"), times.in_session("ts", closed=True, weekdays=False).alias("p5"))
    assert one(out, "p3", "p4", "p5") == [(False,) * 3, (True,) * 3, (True,) * 3, (True, False, True), (True, False, True), (False, False, True), (False, False, True)]


def test_flags_differ_between_modes(spark):
    edges = ["09:34:00", "09:34:59", "09:35:00", "15:55:00", "15:56:00", "16:00:00"]
    t = trades(spark, [(f"2024-01-03T{int(e[:2]) + 5:02d}{e[2:]}", 1) for e in edges]).orderBy("event_id")
    flags = ("market_open_spike_flag", "market_close_spike_flag")
    assert one(t.select(*times.calendar_features("ts", "stream")), *flags) == [(1, 0), (1, 0), (0, 0), (0, 1), (0, 1), (0, 0)]
    assert one(t.select(*times.calendar_features("ts", "batch")), *flags) == [(1, 0), (0, 0), (0, 0), (0, 0), (0, 1), (0, 1)]


def test_daylight_saving_and_iso_year(spark):
    t = trades(spark, [("2024-03-08T14:00:00", 1), ("2024-03-11T14:00:00", 1), ("2024-12-30T12:00:00", 1)]).orderBy("event_id")
    assert [x for (x,) in one(t.select(F.hour(times.ny("ts")).alias("h")), "h")] == [9, 10, 7]
    assert one(t.select(times.iso_year("ts").alias("y"), F.weekofyear("ts").alias("w")), "y", "w")[2] == (2025, 1)


def test_minutes_since_open(spark):
    t = trades(spark, [("2024-01-03T14:00:00", 1), ("2024-01-03T14:30:59", 1), ("2024-01-03T14:29:30.5", 1), ("2024-01-03T21:05:00", 1)]).orderBy("event_id")
    out = t.select(times.minutes_since_open("ts", "stream").alias("s"), times.minutes_since_open("ts", "batch").alias("b"))
    assert one(out, "s", "b") == [(-30, 0), (0, 0), (0, 0), (395, 395)]


def test_labels(spark):
    base = [("2024-01-03T14:55:00", 5), ("2024-01-03T14:56:00", 4), ("2024-01-03T15:00:59", 59), ("2024-01-03T15:01:00", 60), ("2024-01-03T15:01:01", 61)]
    f = trades(spark, [("2024-01-03T15:00:00", 0)])
    assert one(joins.label_next(f, trades(spark, base)), "y1") == [(60.0,)]
    assert one(joins.label_next(f, trades(spark, base[:2])), "y1") == [(4.0,)]
    assert one(joins.label_next(f, trades(spark, base[:1])), "y1") == [(None,)]
    assert one(joins.label_next(f, trades(spark, [base[3], ("2024-01-03T15:01:00", 99)])), "y1") == [(60.0,)]


def test_macro_asof(spark):
    m = spark.createDataFrame([("cpi", dt.date(2024, 1, 2), 1.0), ("cpi", dt.date(2024, 1, 5), 2.0), ("cpi", dt.date(2024, 1, 5), 3.0)], "series string, date date, value double")
    days = spark.createDataFrame([(i, dt.date(2024, 1, i)) for i in (1, 2, 4, 5, 9)], "i int, day date")
    assert dict(one(joins.macro_asof(days, m, F.col("day")), "i", "cpi")) == {1: None, 2: 1.0, 4: 1.0, 5: 3.0, 9: 3.0}


def test_ratios_without_divisor(spark):
    rows = [(0.0, None, 5.0, 1.0), (2.0, 4.0, None, 1.0), (2.0, 4.0, 1.0, 1.0)]
    out = joins.ratios(spark.createDataFrame(rows, "revenue double, balance_totalStockholdersEquity double, netIncome double, balance_totalDebt double"))
    assert one(out, "profit_margin", "debt_to_equity") == [(None, None), (None, 0.25), (0.5, 0.25)]


def test_tickers_in_texts(spark):
    rows = spark.createDataFrame([(0, "$aapl up"), (1, "$GOOGLX"), (2, "heavy metal"), (3, "  "), (4, None), (5, "buy f now")], "i int, text string")
    out = text.tag_tickers(rows, "text", [("meta", "META")], ["AAPL", "GOOGL", "META", "F"])
    assert dict(one(out, "i", "tickers")) == {0: ["AAPL"], 1: ["GOOGL"], 2: ["META"], 3: ["GENERAL"], 4: ["GENERAL"], 5: ["GENERAL"]}
    assert dict(one(text.tag_tickers(rows, "text", [], ["F"], bare=True, default=None), "i", "tickers"))[5] == ["F"]
    assert dict(one(text.score_text(rows, "text"), "i", "sentiment_score"))[3] == 0.0


def test_sequences(spark):
    def seq(n, repeat=False):
        rows = [(f"2024-01-03T15:{i:02d}:10", i) for i in range(n)] + ([(f"2024-01-03T15:{n - 1:02d}:10", 99)] if repeat else [])
        t = features.monotonic(trades(spark, rows), "event_id")
        return features.offset_sequences(t, ["price"]).orderBy("ts").select(F.flatten("sequence").alias("s"))

    assert one(seq(4), "s") == []
    assert one(seq(5), "s") == [([0.0, 1.0, 2.0, 3.0, 4.0],)]
    assert len(one(seq(6), "s")) == 2
    assert one(seq(5, True), "s") == [([0.0, 1.0, 2.0, 3.0, 4.0],)]
    t = trades(spark, [(f"2024-01-03T15:{i:02d}:10", i) for i in range(6)])
    assert one(training.training_sequences(t, ["price"], "price", "ts"), "label") == [(5.0,)]
    assert one(training.training_sequences(t.filter("price < 5"), ["price"], "price", "ts"), "label") == []


def test_reference_price_tiers(spark):
    rows = [("2024-01-03T14:00:00", 1), ("2024-01-03T14:31:00", 2), ("2024-01-03T21:05:00", 3)]
    for n, tier in ((3, "close"), (2, "open"), (1, "first")):
        assert one(serving.daily_reference(trades(spark, rows[:n])), "reference", "tier") == [(float(n), tier)]


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 6)], "k string, at int, v int")
    new = spark.createDataFrame([("a", 2, 7), ("a", 3, 8), ("c", 1, 9)], "k string, at int, v int")
    first = records.upsert_rows(old, new, ["k"], "at")
    assert sorted(one(first, "k", "v")) == [("a", 8), ("b", 6), ("c", 9)]
    assert sorted(one(records.upsert_rows(first, new, ["k"], "at"), "k", "v")) == [("a", 8), ("b", 6), ("c", 9)]


def test_store_upsert_and_rerun(spark, tmp_path):
    from tidemark.sources import sinks

    write = sinks.upsert_batch(f"file://{tmp_path}/s", ["k"], "at")
    for rows in ([("a", 1, 5)], [("a", 2, 6), ("b", 1, 1)], [("a", 2, 6), ("b", 1, 1)]):
        write(spark.createDataFrame(rows, "k string, at int, v int"), 0)
    assert sorted(one(sinks.upserted(spark, f"file://{tmp_path}/s"), "k", "v")) == [("a", 6), ("b", 1)]


def test_companies_csv_and_session_of_shapes(spark, tmp_path):
    from tidemark.sources.readers import read_companies, read_records

    (tmp_path / "c.csv").write_text("ticker_id,ticker,company_name,related_words,is_active,avg_simulated_price\n2,BBB,B Co,null,TRUE, 20\n1,AAA,A Co,\"x,y\",TRUE, 10\n3,CCC,C,null,FALSE,null\n")
    assert one(read_companies(spark, str(tmp_path / "c.csv")), "ticker", "related_words", "avg_simulated_price") == [("AAA", "x,y", 10), ("BBB", None, 20)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "r.txt").write_text('{"ticker":"A","price":1.5}\n{"alias":"cpi","value":2}\n{"broken\n')
    raw = read_records(spark, {"format": "text", "path": str(tmp_path / "t")})
    parts = records.split_shapes(raw, {"trade": ("ticker string, price double", ["ticker", "price"]), "macro": ("alias string, value double", ["alias"])})
    assert {k: v.count() for k, v in parts.items()} == {"trade": 1, "macro": 1, "bad": 1}


def test_numbers(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], "x", 0.7, 0.2, 0.1)], "l array<double>, t string, a double, b double, c double")
    (r,) = df.select(numbers.softmax(F.col("l")).alias("p"), numbers.safe_float("t").alias("f"), numbers.sentiment_score(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()
    assert abs(sum(r["p"]) - 1) < 1e-12 and r["f"] is None and r["s"] == 0.048


def test_post_times(spark):
    rows = spark.createDataFrame([("2024-01-02T03:04:05.123456789Z",), ("2024-01-02T03:04:05+01:00",), ("rubbish",)], "t string")
    out = rows.select(times.parse_post_ts("t", F.lit("2020-01-01").cast("timestamp")).alias("o"))
    assert [x for (x,) in one(out, "o")] == ["2024-01-02T03:04:05.123Z", "2024-01-02T02:04:05.000Z", "2020-01-01T00:00:00.000Z"]


def test_context_defaults_and_gate(spark):
    f = trades(spark, [("2024-01-03T10:00:00", 1), ("2024-01-03T12:00:00", 2)])
    c = spark.createDataFrame([(at("2024-01-03T11:00:00"), 5.0, None)], "ts timestamp, cpi double, ffr double")
    assert one(joins.merge_context(f, c, ["cpi", "ffr"]), "price", "cpi", "ffr") == [(2.0, 5.0, 0.0)]
    assert len(one(joins.merge_context(f, c, ["cpi", "ffr"], False), "price")) == 2


def test_context_of_one_key_is_many_tasks(spark):
    minute = dt.timedelta(minutes=1)
    begin = at("2024-01-03T00:00:00")
    f = spark.createDataFrame([(i, begin + i * 7 * minute) for i in range(800)], "event_id long, ts timestamp")
    seen = {i: float(i) for i in range(3, 800, 113)}  # hours without context between
    c = spark.createDataFrame([(begin + i * 7 * minute, x) for i, x in seen.items()], "ts timestamp, cpi double")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled",)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = joins.merge_context(f, c, ["cpi"], False).select("event_id", "cpi", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {r["event_id"]: r["cpi"] for r in got} == {i: max((x for j, x in seen.items() if j <= i), default=0.0) for i in range(800)}
    assert len({r["task"] for r in got}) > 1


def test_years_shift_only_with_the_trigger(spark):
    rows = [("a", "2025"), ("a", "2024"), ("b", "2024"), ("c", None)]
    df = spark.createDataFrame(rows, "symbol string, calendarYear string")
    assert sorted(one(joins.shift_years(df, 2025), "symbol", "calendarYear"), key=str) == [("a", "2023"), ("a", "2024"), ("b", "2024"), ("c", "0")]
    assert sorted(one(joins.shift_years(df, 2030), "symbol", "calendarYear"), key=str) == sorted(rows, key=str)


def test_context_ready_and_required_columns(spark):
    m = spark.createDataFrame([("cpi",)], "series string")
    assert joins.context_ready(m, m, ("cpi",)) and not joins.context_ready(m, m) and not joins.context_ready(m, m.limit(0), ("cpi",))
    assert records.missing_columns(m, ["series", "date"]) == ["date"]


def test_scaling_downcast_and_ridge(spark):
    t = trades(spark, [(f"2024-01-03T15:{i:02d}:00", i, 2) for i in range(20)]).withColumn("y1", F.col("price") * 2 + 1)
    s = training.scale(t, training.fit_scaler(t, ["price", "size"]), ["price", "size"])
    assert s.agg(F.min("price"), F.max("price"), F.max("size")).first()[:] == (0.0, 1.0, 0.0)
    assert dict(records.downcast(t.select("event_id", "price")).dtypes) == {"event_id": "tinyint", "price": "float"}
    (r,) = training.fit_ridge(t, ["price"], "y1", 1e-9).collect()
    assert [round(w, 4) for w in r["weights"]] == [1.0, 2.0]


def test_json_scalars_keep_booleans_and_texts(spark):
    from tidemark.functions.numbers import json_scalar

    want = {"1": "1.0", "1.5": "1.5", '"12"': "12.0", '"1."': "1.0", '".5"': "0.5", '"-3"': '"-3"', '"1.2.3"': '"1.2.3"', '"abc"': '"abc"', '""': '""', "true": "true", "false": "false", "null": "null", "-7": "-7.0", "[1]": "[1]", '{"a":"1"}': '{"a":"1"}', "12345678901234567890123": "1.2345678901234568E22"}
    rows = spark.createDataFrame([(t,) for t in want] + [("no json",), (None,)], "t string")
    got = {r["t"]: r["v"] for r in rows.select("t", F.to_json(json_scalar(F.try_parse_json("t"))).alias("v")).collect()}
    assert got == want | {"no json": None, None: None}
