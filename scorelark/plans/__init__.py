"""Composite queries built from the operators: catalog service, competitor analytics, daily job."""
