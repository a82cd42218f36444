"""Text to syntax trees: the lexer, the tree and the parser of the SQL dialect."""
