"""Site-audit analytics on Spark: HTML, links, rules, graph, store and reports as DataFrames."""
