"""arborlens: a code-property-graph analytics engine on Spark DataFrames."""
