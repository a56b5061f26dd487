"""Training-data operators: formatting, token output, packing, near-duplicates,
archives, classification, personal data, decontamination and licence scans.

Nothing outside this package imports it; it can be deleted without harm to the rest.
"""
