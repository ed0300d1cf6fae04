"""Structured Streaming entry points.

The original application has no streaming operators (no watermarks, windows or state); its
uploads are whole files. The one streaming piece here is the upload path re-expressed as a
file-drop stream: new CSV files in a folder are appended to a Parquet sales store with
exactly-once bookkeeping in a checkpoint, so the batch operators can read the store.
"""
