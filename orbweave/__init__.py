"""Spherical scene analytics and training-data operators on Spark DataFrames."""
