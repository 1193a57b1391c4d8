"""websilo: web-archive records and corpus operators on Spark DataFrames."""
