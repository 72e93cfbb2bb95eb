"""Table-to-table operators, one module per area of the corpus."""
