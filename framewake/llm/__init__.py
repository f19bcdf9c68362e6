"""Training-data operators over text, pages and media. Nothing outside this subpackage imports it."""
