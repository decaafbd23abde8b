"""Mass-spectra analytics on Spark DataFrames: import, alignment, identification queries, reports."""
