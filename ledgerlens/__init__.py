"""LedgerLens: question answering over tabular financial reports, on Spark DataFrames."""
