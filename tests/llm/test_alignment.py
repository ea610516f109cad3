"""Alignment of two tokenizers against the libraries, text by text."""

import brute
from dnsflow.llm import alignment, common

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " "), (3, "two  blanks\t\n and tabs "), (None, "no id"), (4, "no id"), (4, "no id"), (5, "<|endoftext|> <s> </s>"),
       (6, "é ß 漢字 😀 \x00 \x85 ▁ mark"), (7, "ﬁ ligature ½"), (8, "x" * 3000 + " end"), (9, "the other word " * 9000), (10, " leading"), (11, "😀" * 50),
       (12, "12345 678\r\n\r\n  don't we'll I'M"), (13, "Ünï" * 200)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files():
    import public_tokenizers as tokenizers

    return [open(tokenizers.path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")] + [tokenizers.PATTERN]


def test_query_equals_plain_code(spark):
    docs = common.table(spark, SF, "documents")
    assert rows_of(alignment.op13_alignment(spark, SF)) == brute.alignments([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows_and_small_steps(spark, monkeypatch):
    monkeypatch.setattr(alignment, "STEP_LINKS", 7)
    df = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS block", "'x' AS pair", "3 AS n", "4 AS copies")
    assert rows_of(alignment.align(df, *files(), block_bytes=200)) == brute.alignments(ODD)
    assert alignment.align(df.limit(0), *files()).count() == 0


def test_a_group_of_any_size_is_counted_by_distinct_ids(monkeypatch):
    pair = alignment.Pair(*files())
    text = "😀漢" * 300 + "ab" * 200
    plain = pair.aligned([text])[0]
    monkeypatch.setattr(alignment, "STEP_LINKS", 3)
    small = pair.aligned([text])[0]
    assert plain[:5] == small[:5] and (plain[5] == small[5]).all() and (plain[6] == small[6]).all() and plain[6].sum() == plain[3]
