"""Detection, injection, evaluation and reports over DataFrames."""
