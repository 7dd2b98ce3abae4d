"""Takeoff, resolution, project model, quantities, checks and library operators over DataFrames."""
