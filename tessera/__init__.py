"""A property-graph analytics engine on Spark DataFrames, queried with a Cypher subset."""
