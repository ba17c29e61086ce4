"""Maps the driver's test tables to the library's tables, with the DuckDB oracle."""
