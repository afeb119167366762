"""DataFrame operators: cleaning, chunking, routing, naming, tables and enrichment."""
