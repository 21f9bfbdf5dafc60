"""Training-data operators: decontamination, deduplication, mixing, quality
rules, classifiers, language identification, licence scans, token counts.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries when it is present.
"""
