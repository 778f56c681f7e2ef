"""Small fixtures shared by the tests of the training-data operators."""

SF = "/root/testdata/sf0.001"

#: Nulls, empty, white space, ties, repeated rows, a long text, clashing and odd characters.
ODD_ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from the old barn", "src0"),
    (2, None, None),
    (3, "", "src1"),
    (4, " \t\n ", "src1"),
    (5, "one two", "zzz"),
    (5, "one two", "zzz"),
    (6, "Ünïcode Σίσυφος 漢字 <|endoftext|> don't 123\x1cx", "src0"),
    (7, "word " * 30000, "src0"),
    (8, "the quick brown fox jumps over the lazy dog and runs far away from the old barn", "src2"),
    (None, "no id here", "src3"),
]


def odd_docs(spark):
    """Documents with extra columns whose names clash with those of results."""
    rows = [(a, b, c, "x", 1, 2, "y", 3.5) for a, b, c in ODD_ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard int, slot int, block string, n_chars double")


def no_docs(spark):
    return odd_docs(spark).limit(0)
