"""lakeline: lakehouse ingest, change capture and analytics as PySpark jobs."""
