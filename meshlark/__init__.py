"""meshlark: graph-embedding analytics and training-data operators on PySpark DataFrames."""
