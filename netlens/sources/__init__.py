"""Readers: files and streams of recordings as DataFrames."""
