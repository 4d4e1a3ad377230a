"""Behaviour analytics and corpus preparation on Spark."""
