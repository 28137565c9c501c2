"""Column protection for Spark tables: policies, sealed columns, blind-index search, masking and query checks."""
