"""A Spark-native engine for finding exact and near duplicates and planning their clean-up."""
