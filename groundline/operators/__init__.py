"""Building blocks of queries: DataFrame in, DataFrame out."""
