"""paraloom: a DataFrame-first engine for paragraph corpora.

``sources`` read and write the corpus, ``functions`` hold column expressions,
``operators`` hold the analyses, ``plans`` bind them to the test tables as
named queries, ``streaming`` runs the incremental ones on a stream.  The
subpackage ``llm`` holds the operators for training-data pipelines; nothing
outside it imports it.
"""
