"""The table and the odd texts that the operators' tests share."""

SF = "/root/testdata/sf0.001"


def read(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


ODD = [
    (0, None), (1, ""), (2, " "), (3, "\n\t \n"), (4, "one two"), (5, "One  two"), (6, "one two three four five"),
    (7, "ONE two three four five"), (8, "a b c d e a b c d e f g"), (9, "x" * 30_000), (10, "word " * 4000),
    (11, "é漢字🎉 naïve ß"), (12, "line\nline\n\nline one\nline"), (13, "tail space "), (14, "tail space"),
    (15, "don't 've''s <|endoftext|> x  y \n z"), (16, "a | b | c !! d"),
]
