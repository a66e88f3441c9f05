"""DataFrame operators of the panel algebra."""
