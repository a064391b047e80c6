"""Rows that every operator must take."""

#: Nulls, empty and odd texts, ties and repeated rows.
ODD = [(5, None), (3, ""), (None, "a null id here"), (9, "Ünï “cödé” ½ ﬁ x\ty\n"), (9, "Ünï “cödé” ½ ﬁ x\ty\n"), (1, "one"), (2, "ONE "), (4, "日本語 テスト word " * 30), (6, "aaaaaaa " * 200), (7, "the same text of some words " * 20), (8, "the same text of some words " * 20), (11, "x" * 5000), (12, "tail words follow\x00 here")]
