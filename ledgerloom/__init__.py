"""Analytics on DataFrames: ledger, commitments, corpus, retrieval, text, matching, evaluation and streams."""
