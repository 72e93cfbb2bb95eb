"""Readers and writers: files, tables, and the views over the test tables."""
