"""Cohort modelling and model evaluation as Spark DataFrame jobs."""
