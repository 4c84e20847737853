"""Sources and sinks: parquet/CSV I/O, literal dimensions, test-data adapters."""
