"""Readers and writers of the text formats, alignments and Parquet bundles."""
