"""Spark-first analytics for collections of model-evaluation results."""
