"""Decision support for small businesses on PySpark: ingestion, indicators, segmentation, forecasts and tools."""
