"""Hourly multi-station forecasting and verification on Spark DataFrames."""
