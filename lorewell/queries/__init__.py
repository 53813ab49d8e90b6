"""The query catalogue: Spark plans beside the DuckDB SQL that states the same result."""
