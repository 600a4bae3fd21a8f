"""Retail analytics and daily forecasting as Spark DataFrame operators."""
