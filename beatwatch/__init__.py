"""Public-safety analytics on PySpark: typed events, batch tables, streams, alerts."""
