"""Analytics over semi-structured business documents, in DataFrame operations."""
