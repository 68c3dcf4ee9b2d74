"""Operations of a training-data pipeline over text, vectors and web pages.

Nothing else in the library imports this subpackage.  Each operator module has a general
function (``df`` in, ``df`` out, column names as parameters) and one thin ``query`` for the
driver's tables; ``queries.py`` lists those queries and their SQL twins.
"""
