"""Analytics on keyed time-series tables, as DataFrame operators."""
