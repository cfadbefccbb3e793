"""A graph engine for Spark: generators, transforms, statistics, validation, sources and sinks over edge DataFrames."""
