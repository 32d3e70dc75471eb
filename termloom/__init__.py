"""Termloom: text search and corpus analysis on Spark DataFrames."""
