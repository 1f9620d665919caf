"""riskframe: Spark-native cleaning, profiling, modelling and scoring of clinical survey tables."""

__version__ = "0.1.0"
