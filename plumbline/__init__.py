"""Plumbline: reasoning-path analytics on Spark DataFrames."""
