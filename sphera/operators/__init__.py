"""Operators over DataFrames of points, cells and shapes."""
