"""skimmer: sketch-based analytics as ordinary Spark DataFrames."""
