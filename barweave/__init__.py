"""Daily market-bar analytics on Spark: lake, features, labels, indicators, data quality, research statistics, rule mining."""
