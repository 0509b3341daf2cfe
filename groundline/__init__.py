"""groundline: document retrieval with verifiable citations, and text preparation at corpus scale, as Spark jobs.

The package holds DataFrame transforms only. ``operators`` are the building blocks, ``functions`` the column and array helpers,
``sources`` readers and writers, ``plans`` the composed queries, ``streaming`` the stateful jobs. ``llm`` holds the operators that
prepare training text; nothing else imports it.
"""
