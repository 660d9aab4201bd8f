"""Training-data operators: tokenised output, deduplication, decontamination, filtering, mixing and scoring.

Nothing outside this subpackage imports it.  Python workers and numpy only; Spark does the
distribution, the shuffles and the recovery.
"""
