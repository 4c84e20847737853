"""Row-local operators applied to streaming DataFrames."""
