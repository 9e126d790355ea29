"""Operators for large text corpora: duplicates, leaks, secrets, licences, pages, chats, quality and mixing."""
