"""Training-data operators: corpus operators and their queries.

Nothing else in the library imports this subpackage. Every operator reads
only the columns it names (``doc_id``, ``text`` ...), so extra columns and
clashing names in the input are ignored unless its docstring says otherwise.
"""
