"""A sorted-cell store, graph, document and vector engine expressed on Spark DataFrames."""
