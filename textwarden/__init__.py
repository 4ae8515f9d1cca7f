"""Text screening on Spark: canonical forms, located findings, policies, bounded-lookback enforcement and evaluation."""
