"""Telemetry analytics on Spark DataFrames.

Every public function takes DataFrames (or Columns) and returns them; nothing
here starts a session, collects rows to the driver, or keeps state of its own.
"""
