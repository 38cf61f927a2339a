"""Attribution analytics as Spark DataFrames."""
