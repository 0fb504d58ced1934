"""Set-at-a-time preparation and retrieval of document collections on Spark.

Every operator takes and returns DataFrames (or Columns); nothing whole passes
through the driver, and Python runs only inside Arrow batches.
"""
