"""Column expressions: URLs, media types, hashes, sizes, secrets."""
