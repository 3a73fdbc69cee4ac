"""Operators for preparing training text: deduplication, scoring, decontamination, tokens, chat and licences."""
