"""datagauge: dataset-evaluation analytics on PySpark DataFrames."""
