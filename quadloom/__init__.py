"""quadloom: a PySpark-native engine for graph data (SPARQL and path expressions over DataFrames) and large-scale data preparation."""

__version__ = "0.1.0"
