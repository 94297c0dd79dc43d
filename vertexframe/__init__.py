"""vertexframe: a property-graph query engine that compiles to Spark DataFrames."""
