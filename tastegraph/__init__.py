"""A PySpark-native engine for ratings analytics: matching, similarity, scoring, presentation and evaluation."""
