"""Training-data operators: ten distributed operators over documents, vectors, pages and conversations.

Nothing outside this subpackage imports it.  Each module holds one operator with a general interface;
``queries`` binds them to the standard tables.
"""
