"""Corpus-preparation operators: ten operators, their driver queries and the staged pipeline."""
