"""Sources and sinks: tables in files, literal rows, and what Spark reads and writes by itself."""
