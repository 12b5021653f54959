"""Operators for training text: token ids, leaked evaluation texts, reading level. Nothing else imports this subpackage."""
