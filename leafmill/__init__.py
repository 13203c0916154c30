"""A document analytics engine on Spark DataFrames: sources, text operators, output builders, reports and streams."""
