"""basalt: analytics operators for retrieval, document ETL, operations data and evaluation, on the DataFrame API."""
