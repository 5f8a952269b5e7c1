"""Search, ranking, chunking and evaluation over DataFrames."""
