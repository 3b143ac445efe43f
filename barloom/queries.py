"""All queries of the engine by name, and the SQL that gives the same rows, where there is any."""

from __future__ import annotations

from barloom.queries_accounts import account_queries
from barloom.queries_analyzers import analyzer_queries
from barloom.queries_bars import bar_queries
from barloom.queries_files import file_queries
from barloom.queries_indicators import indicator_queries
from barloom.queries_mining import mining_queries, q_backtest_summary
from barloom.queries_orders import order_queries
from barloom.queries_streaming import streaming_queries

PAIRS = indicator_queries() | bar_queries() | analyzer_queries() | mining_queries() | streaming_queries() | file_queries() | account_queries() | order_queries()
QUERIES = {name: query for name, (query, _) in PAIRS.items()}
ORACLES = {name: sql for name, (_, sql) in PAIRS.items() if sql}
FLAGSHIP = q_backtest_summary
