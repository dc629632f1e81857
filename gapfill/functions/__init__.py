"""Column expressions and small frame helpers that everything else is built from."""
