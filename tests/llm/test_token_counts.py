import public_tokenizers
import sentencepiece

from recordloom.llm.token_counts import token_counts


def expected(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return sorted((str(r.doc_id), len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096)
                  for r in rows)


def counted(docs):
    return sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs).collect())


def test_counts_equal_the_model_on_whole_texts(documents):
    assert counted(documents) == expected(documents.collect())


def test_odd_rows_and_an_empty_table(spark, odd, empty):
    more = spark.createDataFrame([(1, " a  b\n\n c\t d \n"), (2, "▁x▁▁y <s> </s>"), (3, "\n"), (4, " "), (5, "a\u0000b")],
                                 "doc_id bigint, text string")
    assert counted(odd) == expected(odd.collect())
    assert counted(more) == expected(more.collect())
    assert counted(empty) == []
