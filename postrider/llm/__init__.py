"""Training-data operators: quality, secrets, dedup, chat, PII, URL, mixing and decontamination.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries, ``oracles`` the SQL they are compared with.
"""
