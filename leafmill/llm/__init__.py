"""Operators for preparing language-model training data.

The subpackage is self-contained: it imports nothing from the rest of the
library and the rest of the library does not import it.  ``catalog`` lists its
queries and, where SQL can express them, their SQL.
"""
