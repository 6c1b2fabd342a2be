"""docmeter: scores document-parsing output at scale on Spark DataFrames."""
