"""Operators that prepare training text: licences, duplicates, archives, mixing, languages, packing, quality, token files."""
