"""Readers and writers: spreadsheets, catalogues, configuration, documents, logs, derived test inputs."""
