"""Mail analytics and search on Spark DataFrames."""
