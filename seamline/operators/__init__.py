"""Operators: DataFrames of code facts and contracts in, one DataFrame out. Every key is per ``repo``."""
