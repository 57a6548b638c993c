"""DuckDB SQL that checks every query independently of the Spark code."""
