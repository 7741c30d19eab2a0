"""Operations of a training-data pipeline, one module for each operator.

Nothing outside this subpackage imports it.  ``queries.py`` holds the
registered queries, ``sql.py`` the SQL that checks them.
"""
