"""Rows that the tests of all operators share."""

#: Null and empty texts, a null id, a repeated row, ties, white space of all kinds, and long texts.
ODD = [(1, None), (2, ""), (3, "   \n\t\n"), (None, "null id words here"), (5, "same row"), (5, "same row"), (6, "same row"), (7, "a\x0bb\x0cc\rd\x1ce f"), (8, "word " * 30_000), (9, "Ünïcode ẞ İ Σς 漢字 😀 é"), (10, "x" * 5000)]
