"""Spark jobs that turn the text layers of freight documents into clean typed tables, and reports on them."""
