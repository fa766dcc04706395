"""Operations of a training-data pipeline over the tables documents, pages, benchmark and labels.

Nothing else in the library imports this subpackage. Each operator takes and returns DataFrames;
`queries` registers one query per operator with its production parameters.
"""
