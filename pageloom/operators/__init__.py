"""Table jobs: every job takes DataFrames and returns a lazy DataFrame."""
