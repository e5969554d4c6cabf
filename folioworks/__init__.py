"""Spark jobs over large collections of help books: extraction, lookup, search, activity."""
