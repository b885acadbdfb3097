"""Record shapes, explicit everywhere a message or a store is read."""

from __future__ import annotations

# Names of fields and their order, as messages and stored data have them.
MACRO_ALIASES = ("gdp_real", "cpi", "ffr", "t10y", "t2y", "spread_10y_2y", "unemployment")
PRICE_FEATURES = ("price_mean_1min", "price_mean_5min", "price_std_5min", "price_mean_30min", "price_std_30min", "size_tot_1min", "size_tot_5min", "size_tot_30min")
SENTIMENT_FEATURES = (
    "sentiment_bluesky_mean_2hours", "sentiment_bluesky_mean_1day", "sentiment_news_mean_1day", "sentiment_news_mean_3days",
    "sentiment_general_bluesky_mean_2hours", "sentiment_general_bluesky_mean_1day",
)
CALENDAR_FEATURES = ("minutes_since_open", "day_of_week", "day_of_month", "week_of_year", "month_of_year", "market_open_spike_flag", "market_close_spike_flag")
FUNDAMENTAL_FEATURES = ("eps", "free_cash_flow", "profit_margin", "debt_to_equity")
#: 32 ordered features of a training row.
FEATURES = PRICE_FEATURES + SENTIMENT_FEATURES + CALENDAR_FEATURES + FUNDAMENTAL_FEATURES + MACRO_ALIASES

TRADE = "ticker string, timestamp timestamp, price double, size double, exchange string"
BAR = "symbol string, timestamp timestamp, open double, close double, volume double"
MACRO = "series string, date date, value double"
POST = "id string, text string, created_at string, keyword string"
ARTICLE = "id long, symbol_requested string, related string, date string, headline string, summary string, source string, url string, image string"
FORUM_POST = "id string, title string, author string, text string, score long, num_comments long, created_utc double, permalink string, url string, subreddit string"
SENTIMENT = "timestamp timestamp, social string, ticker array<string>, sentiment_score double"
COMPANY = "ticker_id int, ticker string, company_name string, related_words string, is_active boolean, avg_simulated_price int"
FUNDAMENTALS = "symbol string, calendarYear string, eps double, cashflow_freeCashFlow double, revenue double, netIncome double, balance_totalDebt double, balance_totalStockholdersEquity double, reportIndex int, reportDate date"
ANOMALY = "ticker string, timestamp timestamp, anomaly_type string, min_price double, max_price double, min_timestamp timestamp, max_timestamp timestamp, price_difference double"
PREDICTION = "ticker string, timestamp timestamp, prediction double, is_simulated_prediction boolean"
