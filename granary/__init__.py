"""Spark jobs for training-data selection studies: sources, operators, plans and streams."""
