"""Operators of a training-data pipeline: search, cleaning, mixing, token files, archives, packing and classifiers.

Each module holds one operator with a general interface; ``queries`` registers one query per operator on the
given tables and ``sql`` the counterparts that plain SQL can express.
"""
