"""Stages: DataFrame in, DataFrame out."""
