"""Column expressions shared by the jobs; no UDFs."""
