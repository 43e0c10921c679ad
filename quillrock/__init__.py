"""quillrock: grounded retrieval and record analytics on Spark DataFrames."""
