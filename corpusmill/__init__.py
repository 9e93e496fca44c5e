"""Compile documents and tabular rows into validated fine-tuning datasets on Spark.

Every operator is a function from DataFrames to DataFrames.  Nothing here
collects records: the driver only ever sees counts, column names and previews
whose size is the caller's limit.
"""
