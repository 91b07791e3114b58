"""Layout operators: DataFrame in, DataFrame out."""
