"""Matching joins, metrics and checks on documents, workbooks and logs."""
