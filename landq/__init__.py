"""landq: land-record data quality on Spark DataFrames."""
