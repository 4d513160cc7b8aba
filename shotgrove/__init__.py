"""Few-shot, retrieval-augmented text classification data on Spark DataFrames."""
