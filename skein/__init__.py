"""skein: frequency, distribution and order statistics over Spark DataFrames."""
