"""Operators that prepare text and vectors for model training, each as a Spark job."""
