"""Training-data operators: text quality, de-duplication, tokens, chat, mixing.

Nothing outside this subpackage imports it.  Each module holds one operator
(a DataFrame -> DataFrame function with its own parameters) and ``queries``
holds the thin registered queries.
"""
