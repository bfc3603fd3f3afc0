"""Citation analytics on Spark: DataFrame operators over papers, references, citations and sources."""
