"""Dataset operators: cleaning, history, mart, BI, profiling and data quality."""
