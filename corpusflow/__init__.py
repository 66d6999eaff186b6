"""corpusflow: curation, ranking and indicator operators over Spark DataFrames."""
