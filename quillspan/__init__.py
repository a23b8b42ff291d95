"""Quillspan: staged-record analytics as PySpark DataFrame operators."""
