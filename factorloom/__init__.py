"""Factor research on Spark DataFrames: targets, profiles, rolling functions, factor search."""
