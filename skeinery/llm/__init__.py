"""Operators that prepare training data from crawled text."""
