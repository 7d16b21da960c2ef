"""Retail demand analytics as lazy PySpark DataFrame transforms."""

PAIR = ("store_nbr", "item_nbr")
