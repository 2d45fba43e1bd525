"""quadloom: RDF quads, image-space geometry and bulk data preparation on Spark DataFrames."""
