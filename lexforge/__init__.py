"""lexforge: corpus analytics and text-data operators on Spark DataFrames."""
