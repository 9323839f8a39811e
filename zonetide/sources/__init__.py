"""Readers: files and captured answers in, typed DataFrames out."""
