"""Stages: DataFrame in, DataFrame out, lazy."""
