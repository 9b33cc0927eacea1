"""Training-data operators: ten corpus-scale building blocks on documents, pages and embeddings.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries and its SQL.
"""
