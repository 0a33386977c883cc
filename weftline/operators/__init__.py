"""DataFrame operators over capture records."""
