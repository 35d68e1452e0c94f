"""Analytics over JSON payloads and Parquet tables on Apache Spark."""
