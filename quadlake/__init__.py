"""Quality of linked-data metadata catalogues, as Spark DataFrames over quads."""
