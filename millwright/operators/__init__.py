"""Functions from DataFrame to DataFrame."""
