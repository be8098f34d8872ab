"""Training-data operators: fingerprints, training order, URL filters, packing, nearest
neighbours, language identification, mixing, personal data, sharding and near-duplicate removal.

Nothing else in the library imports this subpackage.
"""
