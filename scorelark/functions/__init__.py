"""Scalar functions as Column expressions; pandas UDFs only where no built-in can say it."""
