"""The registered queries of the core, each beside its DuckDB statement."""
