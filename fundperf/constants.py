"""Fixed values of the domain."""

# They must equal the accounting system's codes for right results.
REPORT_FUNDS = ("grad", "undergrad", "brigham_capital", "quant")
EXCLUDED_ASSET_CLASSES = ("OPT", "CASH")
OPTION_CLASS = "OPT"
CORPORATE_ACTION_SELL = "SELL (CA.)"
MONEY_MARKET_TICKER = "VMFXX"
BENCHMARK_PROXY_FUND = "undergrad"
BENCHMARK_PROXY_TICKER = "IWV"
TRADING_DAYS_PER_YEAR = 252
RECENT_LOG_DAYS = 5

# Label of the all-funds line in the overall report.
TOTAL_LABEL = "all"

# Grain of holdings.
HOLDING_KEY = ("fund", "ticker")
POSITION_KEY = ("caldt", "fund", "ticker")
