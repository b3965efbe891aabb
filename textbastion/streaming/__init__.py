"""Streaming forms of the state operators: taint and monitoring by project, a cache with a time to live, sessions."""
