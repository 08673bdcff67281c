"""From specifications to what Spark runs: JSON Schema export and constraint expressions."""
