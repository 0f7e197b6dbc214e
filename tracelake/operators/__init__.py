"""Operators on DataFrames that carry `collection_id` as leading key; every one is lazy."""

#: The leading key of every table.
CID = "collection_id"
