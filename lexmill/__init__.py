"""lexmill: retrieval analytics over court judgments on Spark DataFrames.

The core packages hold the query engine (index, Boolean and ranked search,
statutes, citations, graph, fusion, evaluation); ``lexmill.llm`` holds the
training-data operators and is imported by nothing else here.
"""

__version__ = "0.1.0"
