"""Operations of a training-data pipeline: scoring, scanning, mixing, deduplication, search and tokenising.

Nothing outside this subpackage imports it. Every operator takes DataFrames and returns DataFrames;
null texts count as empty unless a docstring says otherwise, and columns an operator does not name are not read.
"""
