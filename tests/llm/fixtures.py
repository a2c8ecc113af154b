"""Small tables for the operators' edge cases."""

import public_tokenizers

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=None):
    """(doc_id, text, source) rows with the columns of documents; ``extra`` names further string columns."""
    data = [(i, t, "en", s, None if t is None else len(t), *["x"] * len(extra or [])) for i, t, s in rows]
    return spark.createDataFrame(data, COLUMNS + "".join(f", `{c}` string" for c in extra or []))


#: Null and empty texts, repeated rows, a null id, a null source, ties, one long text.
EDGE = [
    (1, "a b c d e f", "s0"), (2, "a b c d e f", "s0"), (3, None, "s1"), (4, "", None), (5, "A, b! c's 12 été", "s1"),
    (6, "one", None), (7, "x y z " * 3000, "s0"), (8, "one", "s2"), (8, "one", "s2"), (None, "no id here", "s2"),
    (9, "日本語 😀 text", "s3"), (10, " \t\n ", "s3"), (-5, "negative id", "s0"),
]
CLASHES = ["_id", "_sha", "_digest", "_copy", "_times", "_quality", "node", "key", "fp0"]
