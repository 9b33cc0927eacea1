"""Operators over feature tables: rules, fusion, evaluation, layout, seals, serving."""
