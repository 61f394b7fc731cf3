"""Player-style analytics for two-player games, on Spark DataFrames."""
