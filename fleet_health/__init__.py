"""Predictive-maintenance analytics for machine fleets, as lazy Spark DataFrame operators."""
