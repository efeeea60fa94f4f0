#: Nulls, empty and blank texts, a very long one, repeated rows and ids, characters of all kinds.
ODD = [
    (0, None),
    (1, ""),
    (2, " \t\n "),
    (3, "one"),
    (4, "one two"),
    (5, "The MIT License. The MIT License."),
    (6, "a" * 200_000),
    (7, "wörter ünd zeichen " * 4000),
    (8, "same text again and again"),
    (8, "same text again and again"),
    (9, "same text again and again"),
    (None, "no id at all here"),
    (None, None),
    (10, "snowman ☃ emoji 🎉 nbsp tab\there  double  spaces \n\n lines\r\nend "),
    (11, "<|endoftext|> ▁ \x00 control \x7f"),
    (12, "日本語 のテキスト и русский текст"),
]
