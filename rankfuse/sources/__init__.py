"""Sources and sinks: views over the driver's Parquet tables, corpus JSON/Parquet/CSV I/O."""
