"""Queries of the library's own operators and the SQL that must give the same rows."""
