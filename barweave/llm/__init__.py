"""Operators for building training corpora: filters, near duplicates, decontamination, packing, archives, classifiers."""
