"""lamina: a columnar dataflow engine on PySpark.

Every operator is a function from DataFrames to DataFrames; Catalyst plans, Spark's Parquet source
does the encoding. See README.md."""
