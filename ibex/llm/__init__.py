"""Operators for preparing training text at scale.

Thirteen operators (exact, substring, suffix-array and near-duplicate removal,
packing, URL rules, secret scanning, benchmark decontamination, unigram token
counts, quality scoring, compression bands, periodic runs, conversation
tries), their registered queries and SQL statements.
Nothing else in the library imports this package.
"""
