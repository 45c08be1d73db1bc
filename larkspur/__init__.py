"""larkspur: ingestion, retrieval, fusion and streaming operators on PySpark DataFrames."""
