"""Exposure attribution and campaign measurement as Spark DataFrame transformations."""
